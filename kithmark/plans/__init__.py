"""Kithmark plans."""
