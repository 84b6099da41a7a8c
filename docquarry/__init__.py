"""Document and image analytics on PySpark."""
