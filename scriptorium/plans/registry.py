"""Queries of the core library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import corpus, evaluation, relational, splits, textual  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
