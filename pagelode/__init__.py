"""pagelode: a PySpark-native documentation search and text-indexing engine."""

__version__ = "0.1.0"
