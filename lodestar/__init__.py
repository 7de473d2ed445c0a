"""A Spark-native analytics engine for Java artifact compatibility."""
