"""A PySpark-native analytics and data-observability engine."""
