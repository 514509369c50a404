"""Document analytics on Spark: streaming."""
