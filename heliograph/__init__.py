"""heliograph: a PySpark-native signal analytics and corpus processing engine."""
