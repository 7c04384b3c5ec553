"""Transforms of log tables."""
