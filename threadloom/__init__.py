"""threadloom: evidence-linking analytics on Spark DataFrames."""
