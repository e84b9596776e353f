"""Usage analytics on Spark: DataFrame, SQL and Structured Streaming operators over request logs."""
