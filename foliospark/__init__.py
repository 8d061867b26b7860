"""A Spark-native analytics engine for long-form text collections."""
