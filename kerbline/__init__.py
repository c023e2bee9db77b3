"""Road-condition analytics on Spark DataFrames."""
