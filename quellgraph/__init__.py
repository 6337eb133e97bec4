"""PySpark-native analytics over typed, weighted trust graphs and the dirty feeds they are built from."""

__version__ = "0.1.0"
