"""Whole queries over the driver's tables, with the SQL that gives the same rows."""

from . import extraction, fields, grounding, relational, retrieval, streams, structure
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "extraction", "fields", "grounding", "relational", "retrieval", "streams", "structure"]
