"""A Spark-native engine for building, deduplicating, profiling and ranking text corpora."""
