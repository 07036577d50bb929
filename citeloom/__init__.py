"""Citation-network analytics on Spark."""
