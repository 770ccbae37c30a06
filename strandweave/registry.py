"""Registered queries and their SQL twins."""

from __future__ import annotations

from strandweave.plans.oracles import ORACLE_SQL
from strandweave.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
