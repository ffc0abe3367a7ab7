"""Retrieval, context assembly and corpus processing as Spark DataFrame plans."""
