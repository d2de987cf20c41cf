"""PySpark-native engine that turns document images and PDF pages into page records."""

__version__ = "0.1.0"
