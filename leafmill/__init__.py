"""Document analysis and search on Spark DataFrames."""
