"""A Spark-native engine for auditing labelled datasets."""
