"""corpusloom: a Spark-native engine for preparing and evaluating text corpora."""
