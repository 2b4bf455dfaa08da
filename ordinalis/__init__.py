"""Survey-response and classifier-evaluation analytics on Spark DataFrames."""
