"""A Spark-native engine for catalogues of web destinations."""
