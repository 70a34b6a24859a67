"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from recordcheck.plans import queries_bibtex, queries_match, queries_review, queries_rules, queries_text
from recordcheck.plans.queries_match import entry_candidates
from recordcheck.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "entry_candidates", "queries_bibtex", "queries_match", "queries_review", "queries_rules", "queries_text"]
