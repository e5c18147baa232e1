"""Measurement and signal analytics expressed as Spark DataFrame operators."""
