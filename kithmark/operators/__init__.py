"""Kithmark operators."""
