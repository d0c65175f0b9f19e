"""The query catalogue: importing this package registers every query."""

from ..catalog import ORACLE, QUERIES
from . import analytics, extended, files, knowledge, learning, logic, more, operations, retrieval, search, textual, vectors

__all__ = ["ORACLE", "QUERIES", "analytics", "extended", "files", "knowledge", "learning", "logic", "more", "operations", "retrieval", "search", "textual", "vectors"]
