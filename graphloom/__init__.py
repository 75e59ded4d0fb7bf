"""A Spark-native engine for entity queries, dataflow operators and keyed writes."""
