"""Tidemill: e-commerce analytics operators as Spark SQL plans."""

__version__ = "0.1.0"
