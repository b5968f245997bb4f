"""Document analytics and retrieval on PySpark."""
