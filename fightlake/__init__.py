"""PySpark-native analytics over combat-log event streams."""
