"""Fixtures, queries and their SQL."""
