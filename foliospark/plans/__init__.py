"""Document analytics on Spark: plans."""
