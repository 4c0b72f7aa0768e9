"""Text analytics on Spark DataFrames."""
