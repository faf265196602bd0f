"""Preprocessing, models and their evaluation."""
