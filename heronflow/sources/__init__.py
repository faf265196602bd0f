"""Readers that turn files and tables into the domain records."""
