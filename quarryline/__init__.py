"""Quarryline: building and maintaining governed analytical tables with PySpark."""
