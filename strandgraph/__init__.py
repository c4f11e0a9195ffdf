"""Graph-retrieval analytics on Spark DataFrames."""
