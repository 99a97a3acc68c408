"""Log analytics on Spark DataFrames and Structured Streaming."""
