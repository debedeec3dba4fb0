"""ledgerlake: a PySpark-native engine for mixed transactional and analytical work."""
