"""Document analytics on Spark: functions."""
