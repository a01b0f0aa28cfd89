"""Time-aligned conversation analytics on Spark."""
