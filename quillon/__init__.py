"""Document retrieval and corpus processing on Spark DataFrames."""
