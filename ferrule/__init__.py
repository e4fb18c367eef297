"""A Spark-native engine for a compact, clause-order-free query language."""
