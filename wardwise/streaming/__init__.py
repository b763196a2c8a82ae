"""Maintenance of tables from streams."""
