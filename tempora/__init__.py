"""Time-series preparation on Spark DataFrames."""
