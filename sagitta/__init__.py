"""A Spark-native engine for vector search and the data processing around it."""
