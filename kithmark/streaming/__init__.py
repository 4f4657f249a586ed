"""Kithmark streaming."""
