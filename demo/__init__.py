"""The operators applied to the star-schema tables, with the SQL that checks them."""
