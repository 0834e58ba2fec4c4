"""Time-aligned evidence analytics on Spark."""
