"""Relational operators: joins, windows, ranking, sets."""
