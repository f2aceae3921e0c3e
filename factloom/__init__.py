"""Graph-pattern document analytics on PySpark."""
