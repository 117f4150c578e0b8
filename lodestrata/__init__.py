"""lodestrata: a Spark-native engine for rules, geometry and tables."""

__version__ = "0.1.0"
