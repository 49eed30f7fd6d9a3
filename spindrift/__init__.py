"""Hybrid document search and index maintenance as Spark jobs."""
