"""lacuna: a PySpark-native engine that mines a document corpus for structural gaps."""
