"""tessaline: a PySpark-native analytics engine for alignment, cluster, sequence and structure tables."""

__version__ = "0.1.0"
