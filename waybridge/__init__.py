"""Trade-document verification and freight-ledger reconciliation on Spark DataFrames."""
