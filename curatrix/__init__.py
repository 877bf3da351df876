"""Spark-native engine for curating records made of text, vectors and labels."""

__version__ = "0.1.0"
