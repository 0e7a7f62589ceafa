"""stratapool: a PySpark-native analytics engine over the catalog of a pooled drive."""
