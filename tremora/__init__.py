"""Tremora: a Spark-native engine for event catalogues and point-process models."""

__version__ = "0.1.0"
