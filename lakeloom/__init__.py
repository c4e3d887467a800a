"""lakeloom: a PySpark-native engine for lakes of tables."""
