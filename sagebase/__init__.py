"""Document knowledge-base analytics on Spark DataFrames."""
