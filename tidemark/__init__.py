"""Relationship-aware analytics on PySpark."""
