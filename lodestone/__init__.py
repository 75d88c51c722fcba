"""lodestone: a Spark-native evidence-memory and retrieval analytics engine."""
