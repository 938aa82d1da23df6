"""marlstone: querying, validating and normalising semi-structured data with Spark."""
