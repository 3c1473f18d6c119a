"""Column-to-column functions; all of them native Spark expressions."""
