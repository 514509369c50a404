"""Document analytics on Spark: sources."""
