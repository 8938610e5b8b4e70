"""A Spark-native engine for indexing, searching and evaluating collections of documents."""
