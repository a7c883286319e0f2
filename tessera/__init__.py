"""Tessera: a PySpark-native engine for web content and training-data tables."""

__version__ = "0.1.0"
