"""Weights, thresholds and user settings."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import Any

# Component weights, thresholds and year scores.
WEIGHTS = {"title": 0.35, "authors": 0.30, "venue": 0.15, "year": 0.10, "publisher": 0.10}
VERY_HIGH, HIGH, POSSIBLE = 0.95, 0.85, 0.70
AMBIGUITY_GAP = 0.06
DISPLAY = 0.45
SAME_WORK_TITLE = 0.90
DOI_TITLE_CONFLICT = 0.60
AUTHOR_OVERLAP_CRITICAL = 0.50
YEAR_EXACT, YEAR_NEAR, YEAR_OTHER = 1.0, 0.6, 0.0
CALIBRATION_THRESHOLDS = (0.70, 0.80, 0.85, 0.90, 0.95, 0.97)

# Sources in order of precedence, and rows that each search returns.
PRECEDENCE = ("Crossref", "DataCite", "DBLP", "OpenAlex", "arXiv")
SEARCH_ROWS = {"Crossref": 6, "DataCite": 5, "DBLP": 8, "OpenAlex": 6}
FAILURES = ("LOOKUP FAILED", "RATE LIMITED", "NETWORK UNAVAILABLE")

# Least milliseconds between requests to a host, and lifetimes of cached answers.
HOST_GAP_MS = {"api.crossref.org": 250, "api.datacite.org": 200, "dblp.org": 500, "api.openalex.org": 150, "export.arxiv.org": 3000, "doi.org": 150}
DEFAULT_GAP_MS = 100
FOUND_TTL_S, ABSENT_TTL_S = 30 * 24 * 3600, 24 * 3600

KEY_PARTS = ("author", "year", "keyword", "venue")


@dataclass(frozen=True)
class KeyScheme:
    parts: tuple[str, ...] = KEY_PARTS
    separator: str = "_"
    lowercase: bool = True


@dataclass(frozen=True)
class Settings:
    mode: str = "clean"
    author_format: str = "last-first"
    key_scheme: KeyScheme = field(default_factory=KeyScheme)
    latex_accents: bool = True
    contact_email: str = ""
    cache_enabled: bool = True
    found_ttl_days: float = 30
    absent_ttl_hours: float = 24


_EMAIL = re.compile(r"[^\s@]{1,64}@[^\s@]{1,190}\.[^\s@]{2,}")


def _bounded(value: Any, default: float, most: float) -> float:
    plain = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    return min(most, max(0, value)) if plain else default


def sanitize_settings(raw: Any) -> Settings:
    """Settings from untrusted data: what is not valid falls back to its default, numbers are clamped."""
    given = raw if isinstance(raw, dict) else {}
    scheme = given.get("key_scheme") if isinstance(given.get("key_scheme"), dict) else {}
    parts, separator, mail = scheme.get("parts"), scheme.get("separator"), given.get("contact_email")
    valid_parts = isinstance(parts, (list, tuple)) and len(parts) > 0 and all(p in KEY_PARTS for p in parts)
    flag = lambda source, name: source[name] if isinstance(source.get(name), bool) else True
    return Settings(
        mode="verify" if given.get("mode") == "verify" else "clean",
        author_format="first-last" if given.get("author_format") == "first-last" else "last-first",
        key_scheme=KeyScheme(
            tuple(dict.fromkeys(parts)) if valid_parts else KEY_PARTS,
            separator if isinstance(separator, str) and re.fullmatch(r"[_:\-.]?", separator) else "_",
            flag(scheme, "lowercase"),
        ),
        latex_accents=flag(given, "latex_accents"),
        contact_email=mail.strip() if isinstance(mail, str) and _EMAIL.fullmatch(mail.strip()) else "",
        cache_enabled=flag(given, "cache_enabled"),
        found_ttl_days=_bounded(given.get("found_ttl_days"), 30, 365),
        absent_ttl_hours=_bounded(given.get("absent_ttl_hours"), 24, 24 * 30),
    )
