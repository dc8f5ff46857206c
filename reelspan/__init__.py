"""Recording and corpus analytics on Spark DataFrames."""
