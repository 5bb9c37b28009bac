"""Graph density analytics on Spark DataFrames."""
