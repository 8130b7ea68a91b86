"""Scarp: a PySpark engine that watches many line-referenced entities over time and ranks them by near-term risk."""
