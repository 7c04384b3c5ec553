"""Whole jobs: from files to log tables, and the queries to check."""
