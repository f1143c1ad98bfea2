"""Retail and port-operations analytics expressed as Spark DataFrame operators."""
