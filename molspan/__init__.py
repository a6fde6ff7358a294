"""Analytics engine for single-molecule footprint data on Spark DataFrames."""
