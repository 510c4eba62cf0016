"""Event-log measurement and corpus preparation on Spark DataFrames."""
