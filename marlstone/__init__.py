"""A PySpark-native analytics engine for xBase tables and Parquet."""
