"""Where lists come from: base tables with a key, and literals."""

from ordinata.sources.literals import literal, scalar, unit
from ordinata.sources.tables import Hints, default_hints, table

__all__ = ["Hints", "default_hints", "literal", "scalar", "table", "unit"]
