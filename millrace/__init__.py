"""A Spark-native analytics engine for star-schema and decision-support queries."""
