"""Access-aware analytics on Spark."""
