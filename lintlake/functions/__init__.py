"""Operators of the static-analysis evidence engine."""
