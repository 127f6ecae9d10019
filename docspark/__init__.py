"""A PySpark-native engine for help archives and document collections."""
