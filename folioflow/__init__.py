"""Document-record analytics on Spark."""
