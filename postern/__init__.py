"""Spark-native bounded index search, facets and keyed tables."""

__version__ = "0.1.0"
