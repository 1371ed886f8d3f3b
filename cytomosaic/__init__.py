"""Spark-native operators for spatial single-cell expression studies."""

__version__ = "0.1.0"
