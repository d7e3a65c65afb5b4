"""Content-based playlist recommendation and corpus analytics on Spark DataFrames."""
