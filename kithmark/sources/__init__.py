"""Kithmark sources."""
