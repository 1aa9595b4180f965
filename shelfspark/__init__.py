"""Product-catalog analytics on Spark DataFrames."""
