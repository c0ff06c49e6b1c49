"""indexloom: a Spark-native analytics engine for equity-index data."""

__version__ = "0.1.0"
