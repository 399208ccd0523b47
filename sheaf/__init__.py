"""Sheaf: a PySpark-native analytics engine for archives of documents."""

__version__ = "0.1.0"
