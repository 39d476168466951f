"""A PySpark-native analytics engine for public-record data."""
