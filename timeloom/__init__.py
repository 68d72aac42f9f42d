"""Timeline and corpus analytics on Spark DataFrames."""
