"""Bank-statement ledgers as Spark DataFrames."""
