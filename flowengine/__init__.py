"""Recreation-flow analytics on Spark DataFrames."""
