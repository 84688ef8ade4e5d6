"""Column -> Column helpers: text, numbers, dates and similarity."""
