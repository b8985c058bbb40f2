"""tessera: a PySpark-native analytics engine for event-level measurement tables."""

__version__ = "0.1.0"
