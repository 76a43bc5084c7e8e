"""Deduplication of arriving files."""
