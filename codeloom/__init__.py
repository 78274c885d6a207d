"""Code-intelligence analytics on PySpark."""
