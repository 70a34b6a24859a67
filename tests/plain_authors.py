"""Comparison of author lists, one pair at a time, that the Column expressions are tested against."""

import re
from typing import NamedTuple

from recordcheck.functions.authors import Author, _given, name_key
from recordcheck.functions.latex import latex_to_unicode
from recordcheck.functions.text import EDIT_CHARS


def edit_ratio(a: str, b: str) -> float:
    if not a or not b:
        return float(not a and not b)
    longest = max(len(a), len(b))
    if longest > EDIT_CHARS:
        a, b = a[:EDIT_CHARS], b[:EDIT_CHARS]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return 1 - row[-1] / longest


def _same_family(a: Author, b: Author) -> bool:
    x, y = name_key(a.family), name_key(b.family)
    ends = lambda n: name_key((re.split(r"\s+", latex_to_unicode(n)) or [""])[-1])
    return x == y or ends(a.family) == ends(b.family) or (min(len(x), len(y)) > 3 and (x.endswith(y) or y.endswith(x)))


def pair_similarity(a: Author, b: Author) -> float:
    """Likeness of two names by fixed steps."""
    if a.literal or b.literal:
        whole = [name_key(n.literal if n.literal is not None else n.family + n.given) for n in (a, b)]
        return float(edit_ratio(*whole) >= 0.9)
    if not _same_family(a, b):
        family = name_key(a.family), name_key(b.family)
        given = name_key(a.given), name_key(b.given)
        if family[0] and family == given[::-1]:
            return 0.85  # family and given names swapped
        return 0.6 if edit_ratio(*family) >= 0.85 else 0.0
    (first, full), (other, other_full) = _given(a.given), _given(b.given)
    if not first or not other:
        return 0.9
    if first[0] != other[0]:
        return 0.25
    if full and other_full and not (full[0].startswith(other_full[0]) or other_full[0].startswith(full[0])):
        return 0.3
    short = min(len(first), len(other))
    return 1.0 if short == 1 or first[:short] == other[:short] else 0.8


class Comparison(NamedTuple):
    score: float = 0.0
    first_match: bool = False
    overlap: float = 0.0
    count_a: int = 0
    count_b: int = 0
    fuller: bool = False
    identical: bool = False


def compare_lists(a: list[Author], b: list[Author], truncated: bool = False) -> Comparison:
    """Likeness of author lists by place and regardless of order; a truncated list is not held against its length."""
    if not a or not b:
        return Comparison(count_a=len(a), count_b=len(b))
    least, most = sorted((len(a), len(b)))
    table = [[pair_similarity(x, y) for y in b] for x in a]
    placed = 0.0
    for k in range(least):  # sum() would correct for rounding
        placed += table[k][k]
    placed /= least if truncated else most
    rows = table if len(a) <= len(b) else [list(c) for c in zip(*table)]
    free, matched = set(range(most)), 0
    for row in rows:  # each in turn takes the best that is left, the first of equals
        best = max(sorted(free), key=lambda j: row[j], default=None)
        if best is not None and row[best] >= 0.8:
            free.discard(best)
            matched += 1
    overlap = matched / least
    score = max(placed, 0.9 * overlap * (1 if truncated else least / most))
    keys = lambda names: [(name_key(n.family), name_key(n.given)) for n in names]
    fuller = score >= 0.9 and len(a) == len(b) and any(len(_given(y.given)[1]) > len(_given(x.given)[1]) for x, y in zip(a, b))
    return Comparison(score, table[0][0] >= 0.8, overlap, len(a), len(b), fuller, not truncated and keys(a) == keys(b))
