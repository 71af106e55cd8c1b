"""A Spark-native engine for building, running and scoring retrieval pipelines."""

__version__ = "0.1.0"
