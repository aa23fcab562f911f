"""A PySpark-native analytics engine for structured legal and safety text."""
