"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""
from __future__ import annotations

from recset.llm import queries

QUERIES = queries.QUERIES
SQL = queries.SQL
