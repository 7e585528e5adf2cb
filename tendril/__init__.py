"""tendril: document screening, retrieval and ranking on Spark DataFrames."""
