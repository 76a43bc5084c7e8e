"""Quernstone: deduplication analytics as PySpark DataFrame operators."""
