"""Document analytics on Spark: operators."""
