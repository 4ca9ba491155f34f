"""tidemark: business-ledger analytics on Spark DataFrames."""
