"""A PySpark-native domain-intelligence analytics engine."""
