"""Graph-augmented retrieval analytics as Spark DataFrame plans."""
