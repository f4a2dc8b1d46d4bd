"""PySpark-native geographic text analytics: declarative operators over DataFrames."""

__version__ = "0.1.0"
