"""lexmill: document-segment analytics, quality checks and corpus preparation on Spark DataFrames."""
