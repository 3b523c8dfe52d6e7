"""A Spark-native engine for relational, metric, log, trace, profile and stream queries."""

__version__ = "0.1.0"
