"""Spark-native analytics for account-to-account transaction ledgers."""

__version__ = "0.1.0"
