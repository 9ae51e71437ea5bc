"""Column functions that Spark doesn't have."""
