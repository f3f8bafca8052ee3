"""Registered queries and the same results in SQL."""
