"""Coverage, isolation and evidence analytics on Spark DataFrames."""
