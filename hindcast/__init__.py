"""Outcome queries over longitudinal event logs on PySpark."""
