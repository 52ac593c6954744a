"""Spark-native analytics over cryptographic findings, with operators for large text corpora in lodestrata.llm."""
