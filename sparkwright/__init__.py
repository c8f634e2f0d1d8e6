"""A Spark-native engine for evidence graphs, vector retrieval and corpus processing."""
