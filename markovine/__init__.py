"""Statistical analysis of many numeric sequences with Spark."""
