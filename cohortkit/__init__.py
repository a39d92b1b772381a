"""Multi-year health-survey analytics on Spark DataFrames."""
