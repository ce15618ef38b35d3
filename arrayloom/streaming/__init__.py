"""Structured Streaming counterparts of mergeable operators."""
