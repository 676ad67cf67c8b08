"""Retrieval over document corpora as Spark jobs."""
