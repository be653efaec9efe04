"""Moment retrieval, alignment, ranking and evaluation as DataFrame transforms."""
