"""Point-in-time event studies as PySpark DataFrame operators."""
