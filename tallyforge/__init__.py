"""tallyforge: a Spark-native engine for evaluating collections of documents."""
