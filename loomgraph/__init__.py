"""Graph-shaped analytics on PySpark."""
