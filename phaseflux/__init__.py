"""Trial-trajectory analytics on Spark DataFrames."""
