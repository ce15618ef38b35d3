"""Queries and how they are registered."""
