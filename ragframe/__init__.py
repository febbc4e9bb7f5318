"""ragframe: retrieval, conversation and corpus analytics as PySpark DataFrame plans."""
