"""lexmill: a PySpark-native engine for extraction datasets over document corpora."""

__version__ = "0.1.0"
