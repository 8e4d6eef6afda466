"""pmx: a PySpark-native analytics engine for event-contract trade data."""
