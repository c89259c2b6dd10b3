"""furrow: a PySpark-native panel analytics engine."""
