"""Log analytics as PySpark DataFrame operators."""
