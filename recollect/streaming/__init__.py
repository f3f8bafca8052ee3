"""Streaming forms of the jobs."""
