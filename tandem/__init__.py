"""Tandem: market-data and pair analytics as PySpark DataFrame operators."""
