"""Composite jobs: the functions a user calls."""
