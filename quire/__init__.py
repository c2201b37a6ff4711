"""quire: a Spark-native document-corpus engine."""
