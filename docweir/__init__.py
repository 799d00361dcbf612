"""Document and retrieval analytics on Spark DataFrames."""
