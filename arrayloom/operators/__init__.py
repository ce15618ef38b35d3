"""Operators on frames and tensors."""
