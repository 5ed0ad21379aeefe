"""reviewloom: Spark-native analytics over customer-review text."""

__version__ = "0.1.0"
