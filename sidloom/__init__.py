"""sidloom: Spark-native analytics over behavior logs, Semantic IDs, vectors and texts."""
