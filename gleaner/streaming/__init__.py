"""Scores of rows as they arrive."""
