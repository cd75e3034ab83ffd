"""Tidemark: an e-commerce data lake operated as plain Spark jobs."""
