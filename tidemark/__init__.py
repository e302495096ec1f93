"""tidemark: market-data analytics on PySpark DataFrames."""
