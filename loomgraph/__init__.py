"""A Spark-native knowledge-graph analytics engine."""
