"""Kithmark: identity, library and corpus analytics as Spark DataFrame operators."""
