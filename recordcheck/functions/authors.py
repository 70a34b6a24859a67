"""Author names and author lists."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from recordcheck.functions.arrow import arrow_function
from recordcheck.functions.binding import bound
from recordcheck.functions.latex import latex_to_unicode, unicode_to_latex
from recordcheck.functions.text import edit_similarity, fold_diacritics
from recordcheck.schema import AUTHOR, AUTHORS

# Words that belong to the surname after them in a display name.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "da", "di", "du", "le", "la", "dos", "das", "ter", "ten", "bin", "al")


def remembered(function: Callable) -> Callable:
    """Keeps results of a function of strings; a plain closure, as executors get functions by value."""
    known: dict = {}

    def call(*arguments: str):
        if arguments not in known:
            if len(known) >= 100_000:
                known.clear()
            known[arguments] = function(*arguments)
        return known[arguments]

    return call


class Author(NamedTuple):
    family: str
    given: str = ""
    literal: str | None = None


def as_author(value) -> Author:
    """From a Row, a dict or an Author; a missing name counts as empty."""
    get = value.get if isinstance(value, dict) else lambda k: getattr(value, k, None)
    return Author(get("family") or "", get("given") or "", get("literal"))


def outside_braces(text: str, separator: str) -> list[str]:
    """Pieces of a text between matches of `separator` at brace depth 0."""
    pieces, begin, depth, at = [], 0, 0, 0
    unit = re.compile(rf"(?P<brace>[{{}}])|(?P<cut>{separator})", re.I)
    while m := unit.search(text, at):
        at = m.end()
        if m["brace"]:
            depth = depth + 1 if m["brace"] == "{" else max(0, depth - 1)
        elif depth:
            at = m.start() + 1
        else:
            pieces.append(text[begin : m.start()])
            begin = at
    return [*pieces, text[begin:]]


def _particle(word: str) -> bool:
    plain = latex_to_unicode(word)
    return bool(plain) and plain[0] == plain[0].lower() != plain[0].upper()


def parse_name(raw: str) -> Author:
    """One BibTeX name; values keep their LaTeX."""
    name = raw.strip()
    if len(name) > 1 and name[0] == "{" and name[-1] == "}" and "{" not in name[1:-1]:
        return Author(name[1:-1], "", name[1:-1])
    parts = [p.strip() for p in outside_braces(name, ",")]
    if len(parts) > 1:
        return Author(parts[0], " ".join(parts[2:] if len(parts) > 2 else parts[1:]))
    words = [w for w in outside_braces(name, r"[\s~]") if w]
    if len(words) < 2:
        return Author("".join(words))
    last = next((k for k in range(1, len(words) - 1) if _particle(words[k])), len(words) - 1)
    return Author(" ".join(words[last:]), " ".join(words[:last]))


def parse_list(value: str | None) -> tuple[list[Author], bool]:
    """An author field's names, and whether it ends in others or et al."""
    names = [n.strip() for n in outside_braces(re.sub(r"\s+", " ", value or ""), r"\s+and\s+")]
    whole = [n for n in names if n and not re.fullmatch(r"others|et\.?\s*al\.?", n, re.I)]
    return [parse_name(n) for n in whole], any(n and n not in whole for n in names)


def split_display_name(name: str | None) -> Author:
    """A "Given Particle Family" name as sources print it, without a homonym number."""
    words = re.sub(r"\s+\d{4}$", "", name or "").split()
    if len(words) < 2:
        return Author("".join(words))
    last = len(words) - 1
    while last > 1 and words[last - 1].lower() in PARTICLES:
        last -= 1
    return Author(" ".join(words[last:]), " ".join(words[:last]))


def first_family(authors: Column) -> Column:
    """The first author's family or literal name without braces and accent marks, as it goes into a search; empty for none."""
    lead = F.get(authors, F.lit(0))
    return F.regexp_replace(F.coalesce(lead["literal"], lead["family"], F.lit("")), r"""[{}\\'"`^~]""", "")


@remembered
def name_key(text: str) -> str:
    return re.sub("[^a-z]", "", fold_diacritics(latex_to_unicode(text)).lower())


@remembered
def _given(text: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Initials and full given names."""
    words = [w for w in re.split(r"[\s.-]+", fold_diacritics(latex_to_unicode(text))) if w]
    return tuple(w[0].lower() for w in words), tuple(w.lower() for w in words if len(w) > 1)


AUTHOR_KEYS = "array<struct<whole:string,literal:boolean,family:string,ends:string,given:string,initials:array<string>,full:array<string>>>"
COMPARISON = "struct<score:double,first_match:boolean,overlap:double,count_a:int,count_b:int,fuller:boolean,identical:boolean>"


def format_name(name: Author, style: str = "last-first", encode: Callable[[str], str] = str) -> str:
    if name.literal:
        return f"{{{encode(name.literal)}}}"
    family, given = encode(name.family), encode(name.given)
    several = " " in family
    if not given:
        return f"{{{family}}}" if several and style == "first-last" else family
    if style == "last-first":
        return f"{family}, {given}"
    return f"{given} {{{family}}}" if several and not re.match("[a-z]", family) else f"{given} {family}"


def format_list(names: list[Author], style: str = "last-first", from_unicode: bool = False, truncated: bool = False) -> str:
    encode = unicode_to_latex if from_unicode else str
    return " and ".join([*(format_name(n, style, encode) for n in names), *["others"] * truncated])


def display_name(name: Author) -> str:
    return latex_to_unicode(name.literal or " ".join(p for p in (name.given, name.family) if p))


def _parsed(value: str | None) -> dict:
    names, truncated = parse_list(value)
    return {"authors": [n._asdict() for n in names], "truncated": truncated}


parse_authors = arrow_function(_parsed, f"struct<authors:{AUTHORS},truncated:boolean>")
parse_author = arrow_function(lambda name: None if name is None else parse_name(name)._asdict(), AUTHOR)
display_author = arrow_function(lambda name: split_display_name(name)._asdict(), AUTHOR)


def _names(value) -> list[Author]:
    return [as_author(v) for v in value] if value is not None else []


def _keys_of(name: Author) -> dict:
    initials, full = _given(name.given)
    ends = name_key((re.split(r"\s+", latex_to_unicode(name.family)) or [""])[-1])
    whole = name_key(name.literal if name.literal is not None else name.family + name.given)
    return {"whole": whole, "literal": bool(name.literal), "family": name_key(name.family), "ends": ends, "given": name_key(name.given), "initials": list(initials), "full": list(full)}


def author_keys(names: Column) -> Column:
    """What comparing an author list takes of each name; a missing list is empty. Takes Python: compute it once a record."""
    kind = _parse_datatype_string(AUTHOR_KEYS)

    @F.pandas_udf(kind)
    def run(names: pd.Series) -> pd.Series:
        return pd.Series([[_keys_of(n) for n in _names(value)] for value in names], dtype=object)

    return run(names)


def name_likeness(a: Column, b: Column) -> Column:
    """Likeness of two names, as their keys, by fixed steps."""
    ratio = lambda c: edit_similarity(a[c], b[c])
    shorter = F.least(F.char_length(a["family"]), F.char_length(b["family"]))
    related = (a["family"] == b["family"]) | (a["ends"] == b["ends"]) | ((shorter > 3) & (F.endswith(a["family"], b["family"]) | F.endswith(b["family"], a["family"])))
    swapped = (a["family"] != "") & (a["family"] == b["given"]) & (b["family"] == a["given"])
    first = lambda n, c: F.get(n[c], F.lit(0))
    begins = F.startswith(first(a, "full"), first(b, "full")) | F.startswith(first(b, "full"), first(a, "full"))
    short = F.least(F.size(a["initials"]), F.size(b["initials"]))
    of_given = (
        F.when(short == 0, 0.9)
        .when(first(a, "initials") != first(b, "initials"), 0.25)
        .when(~begins, 0.3)
        .when((short == 1) | (F.slice(a["initials"], F.lit(1), short) == F.slice(b["initials"], F.lit(1), short)), 1.0)
        .otherwise(0.8)
    )
    apart = F.when(swapped, 0.85).when(ratio("family") >= 0.85, 0.6).otherwise(0.0)
    whole = F.when(ratio("whole") >= 0.9, 1.0).otherwise(0.0)
    return F.when(a["literal"] | b["literal"], whole).when(related, of_given).otherwise(apart)


def compare_author_keys(a: Column, b: Column, truncated: Column) -> Column:
    """Comparison of two author lists, as their keys, by place and regardless of order; a truncated list is not held against its length.

    The names of the shorter list each take, in turn, the best that is left of the longer, the first of equals: an ordered fold.
    """

    def matched(likeness: Column, least: Column, most: Column, upright: Column) -> Column:
        value = lambda k, j: F.when(upright, F.get(F.get(likeness, k), j)).otherwise(F.get(F.get(likeness, j), k))

        def step(free: Column, k: Column) -> Column:
            best = F.array_max(F.transform(free, lambda j: F.struct(value(k, j).alias("value"), (-j).alias("place"))))
            return bound(lambda best: F.when(best["value"] >= 0.8, F.filter(free, lambda j: j != -best["place"])).otherwise(free), best)

        places = F.sequence(F.lit(0), F.greatest(most, F.lit(1)) - 1)
        return most - F.size(F.aggregate(F.sequence(F.lit(0), F.greatest(least, F.lit(1)) - 1), places, step))

    def of(a: Column, b: Column, truncated: Column, likeness: Column, least: Column, most: Column) -> Column:
        placed = F.aggregate(F.sequence(F.lit(0), least - 1), F.lit(0.0), lambda total, k: total + F.get(F.get(likeness, k), k))
        placed = placed / F.when(truncated, least).otherwise(most)
        overlap = matched(likeness, least, most, F.size(a) <= F.size(b)) / least
        score = lambda overlap: F.greatest(placed, 0.9 * overlap * F.when(truncated, F.lit(1.0)).otherwise(least / most))
        more = F.exists(F.arrays_zip(F.transform(a, lambda n: F.size(n["full"])).alias("a"), F.transform(b, lambda n: F.size(n["full"])).alias("b")), lambda z: z["b"] > z["a"])
        names = lambda keys: F.transform(keys, lambda n: F.struct(n["family"], n["given"]))
        done = lambda score, overlap, first: F.struct(
            score.alias("score"), first.alias("first_match"), overlap.alias("overlap"), F.size(a).alias("count_a"), F.size(b).alias("count_b"),
            ((score >= 0.9) & (F.size(a) == F.size(b)) & more).alias("fuller"), (~truncated & (names(a) == names(b))).alias("identical"),
        )
        return bound(lambda overlap: bound(done, score(overlap), overlap, F.get(F.get(likeness, F.lit(0)), F.lit(0)) >= 0.8), overlap)

    def sized(a: Column, b: Column, truncated: Column) -> Column:
        likeness = F.transform(a, lambda x: F.transform(b, lambda y: name_likeness(x, y)))
        found = bound(of, a, b, truncated, likeness, F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b)))
        none = F.struct(F.lit(0.0), F.lit(False), F.lit(0.0), F.size(a), F.size(b), F.lit(False), F.lit(False)).cast(COMPARISON)
        return F.when((F.size(a) == 0) | (F.size(b) == 0), none).otherwise(found.cast(COMPARISON))

    return bound(sized, a, b, F.coalesce(truncated, F.lit(False)))


def compare_authors(a: Column, b: Column, truncated: Column) -> Column:
    """The same of two author arrays, whose keys are made on the way."""
    return compare_author_keys(author_keys(a), author_keys(b), truncated)


def formatted_authors(names, style: str = "last-first", from_unicode: bool = True):
    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return pd.Series([None if n is None else format_list(_names(n), style, from_unicode) for n in names], dtype=object)

    return run(names)


def displayed_authors(names):
    """Names for reading, joined by semicolons: Column expressions, as nothing is decoded."""
    return F.array_join(F.transform(names, lambda n: F.concat_ws(" ", F.nullif(n["given"], F.lit("")), F.nullif(n["family"], F.lit("")))), "; ")
