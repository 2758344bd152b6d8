"""tessella: a PySpark-native data-preparation and analytics engine."""

__version__ = "0.1.0"
