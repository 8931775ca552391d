"""spatialith: a PySpark-native engine for spatial-reasoning datasets."""
