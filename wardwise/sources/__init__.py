"""Readers of open-data files."""
