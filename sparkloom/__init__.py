"""A Spark-native engine for semantic search, logic queries, event analytics and corpus preparation."""
