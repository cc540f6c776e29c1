"""Sequence-variant analytics on PySpark."""
