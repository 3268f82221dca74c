"""Hybrid retrieval, its evaluation and training-data operators as Spark plans."""
