"""All registered queries of the library, by name."""

from . import analytics, extras, library, timeline  # noqa: F401  they register on import
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
