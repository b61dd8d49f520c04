"""tidebook: a PySpark-native engine for order-by-order exchange feed data."""

__version__ = "0.1.0"
