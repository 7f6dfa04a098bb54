"""marlstone: analytics on Spark DataFrames."""
