"""Retrieval, citation and corpus processing on Spark."""
