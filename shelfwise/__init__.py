"""Assortment and price analytics as chainable Spark DataFrame operators."""

__version__ = "0.1.0"
