"""Retrieval, ranking and evidence analytics expressed as Spark DataFrame plans."""
