"""Operators on tables of files, spans and chunks."""
