"""A Spark-native engine for filtered vector search and document storage."""
