"""Spark-native graph-retrieval analytics over dialogue and document corpora."""
