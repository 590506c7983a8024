"""Spark-native analytics over sparse, versioned, wide-column data."""
