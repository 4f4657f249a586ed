"""Kithmark functions."""
