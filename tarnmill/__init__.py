"""tarnmill: a PySpark-native engine for retail revenue warehousing and near-duplicate resolution."""
