"""Accepted suggestions applied to an entry's original text, and differences between texts.

Without a layout suggestion only the spans that accepted changes name are touched; with nothing accepted the text comes back
as it was.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordcheck.functions.arrow import arrow_function
from recordcheck.functions.titles import wrap_term
from recordcheck.sources.bibtex import parse_bibtex

# The order of fields in a tidied entry, and of kinds of changes.
FIELD_ORDER = (
    "author", "editor", "title", "subtitle", "booktitle", "journal", "journaltitle", "series", "edition", "volume", "number", "issue", "pages",
    "articleno", "numpages", "year", "month", "date", "publisher", "organization", "address", "location", "school", "institution", "howpublished",
    "isbn", "issn", "doi", "url", "urldate", "eprint", "archiveprefix", "eprinttype", "primaryclass", "keywords", "abstract", "note",
)
PATCH_ORDER = ("set", "rename", "remove", "wrap", "layout")
_PLACE = {name: n for n, name in enumerate(FIELD_ORDER)}
_RANK = {kind: n for n, kind in enumerate(PATCH_ORDER)}
#: Lines of one text times lines of the other from which no common lines are looked for.
DIFF_CELLS = 4_000_000


def simple_inner(field: dict | None) -> str | None:
    """The inside of a value of one part that is no macro."""
    parts = field["parts"] if field else ()
    return parts[0]["text"] if len(parts) == 1 and parts[0]["kind"] != "macro" else None


@dataclass(slots=True)
class Change:
    """What is to become of one field."""

    name: str
    raw: str | None = None
    to: str | None = None
    gone: bool = False


class Entry:
    """An entry of a text that was read, with what all patches of it need: it is found once and stays as it is."""

    def __init__(self, text: str, entry: dict):
        self.entry = entry
        self.fields: dict[str, dict] = {}
        self.rows: list[tuple[str, str, str]] = []
        for f in entry["fields"]:
            name = f["name"].lower()
            self.fields.setdefault(name, f)
            lone = f["parts"][0] if len(f["parts"]) == 1 else {}
            raw = f"{{{lone['text']}}}" if lone.get("kind") in ("quoted", "braced") else text[f["value_start"] : f["value_end"]]
            self.rows.append((name, f["name"], raw))
        self._wrapped: dict[tuple[str | None, str | None], str | None] = {}

    def wrapped(self, value: str | None, term: str | None) -> str | None:
        if (value, term) not in self._wrapped:
            self._wrapped[value, term] = wrap_term(value, term)
        return self._wrapped[value, term]


class _Plan:
    """Changes of one entry, gathered from suggestions in order of their kind."""

    def __init__(self, read: Entry):
        self.read, self.fields = read, read.fields
        self.changes: dict[str, Change] = {}
        self.type: str | None = None
        self.key: str | None = None
        self.layout = False
        self.terms: dict[str, list[str]] = {}

    def of(self, name: str) -> Change:
        return self.changes.setdefault(name.lower(), Change(name))

    def inner(self, name: str) -> str | None:
        change = self.changes.get(name)
        return change.raw[1:-1] if change and change.raw is not None else simple_inner(self.fields.get(name))

    def take(self, s: dict) -> str | None:
        """Adds a suggestion; says why if it can't be."""
        name, kind = s["field"].lower(), s["kind"]
        if s["field"] == "ENTRY" and kind == "layout":
            self.layout = True
        elif s["field"] == "ENTRYTYPE" and kind == "set":
            self.type = s["value"]
        elif s["field"] == "KEY" and kind == "set":
            self.key = s["value"]
        elif kind == "set":
            self.of(s["field"]).raw = f"{{{s['value']}}}"
        elif kind == "remove":
            self.of(s["field"]).gone = True
        elif kind == "rename":
            target = self.changes.get(s["to"].lower())
            if name not in self.fields:
                return f"There is no field {s['field']}"
            if s["to"].lower() in self.fields or (target and target.raw):
                return f"A {s['to']} field already exists"
            self.of(s["field"]).to = s["to"]
        elif kind == "wrap":
            if self.inner(name) is None:
                return f"{s['field']} is made of macros or parts, so its terms are to be put in braces by hand"
            self.terms.setdefault(name, []).append(s["term"])
        return None

    def wrap(self) -> None:
        for name, terms in self.terms.items():
            before = after = self.inner(name)
            for term in terms:
                after = self.read.wrapped(after, term)
            if after != before:
                planned = self.changes.get(name)
                quoted = name in self.fields and not (planned and planned.raw) and self.fields[name]["parts"][0]["kind"] == "quoted"
                self.of(name).raw = f'"{after}"' if quoted else f"{{{after}}}"


def _removal(text: str, entry: dict, f: dict) -> tuple[int, int, str]:
    """A field with the comma after it (the one before it, if it is the last), and its line if nothing else is on it."""
    start, end = f["name_start"], f["value_end"]
    after = re.compile(r"\s*,").match(text, end)
    if after and after.end() <= entry["close_pos"]:
        end = after.end()
    else:
        before = re.search(r",\s*$", text[entry["key_end"] : start])
        start = entry["key_end"] + before.start() if before else start
    line = text.rfind("\n", 0, start) + 1
    stop = text.find("\n", end)
    if stop >= 0 and not text[line:start].strip() and not text[end:stop].strip():
        start, end = line, stop + 1
    return start, end, ""


def _insertion(text: str, entry: dict, new: list[Change]) -> tuple[int, int, str]:
    """New fields after the last one, in the style of those that are there."""
    if not entry["fields"]:
        return entry["key_end"], entry["key_end"], "".join(f",\n  {c.name} = {c.raw}" for c in new)
    last = entry["fields"][-1]
    gaps = [text[f["name_end"] : text.index("=", f["name_end"])] for f in entry["fields"]]
    widths = {len(f["name"]) + len(g) for f, g in zip(entry["fields"], gaps)}
    aligned = len(gaps) > 1 and len(set(gaps)) > 1 and len(widths) == 1
    space = text[text.index("=", last["name_end"]) + 1 : last["value_start"]]
    space = " " if "\n" in space else space
    separator = " "
    if "\n" in text[entry["key_end"] : entry["close_pos"]]:
        line = text[text.rfind("\n", 0, last["name_start"]) + 1 : last["name_start"]]
        separator = "\n" + re.match(r"[ \t]*", line)[0]
    body = []
    for c in new:
        gap = " " * max(1, min(widths) - len(c.name)) if aligned else gaps[-1]
        body.append(f"{separator}{c.name}{gap}={space}{c.raw}")
    trailing = re.compile(r"\s*,").match(text, last["value_end"])
    if trailing and trailing.end() <= entry["close_pos"]:
        return trailing.end(), trailing.end(), "".join(b + "," for b in body)
    return last["value_end"], last["value_end"], "".join("," + b for b in body)


def _patched(text: str, entry: dict, plan: _Plan) -> str:
    edits = []
    if plan.type:
        edits.append((entry["type_start"], entry["type_end"], plan.type))
    if plan.key:
        edits.append((entry["key_start"], entry["key_end"], plan.key))
    for name, change in plan.changes.items():
        f = plan.fields.get(name)
        if f and change.gone:
            edits.append(_removal(text, entry, f))
        elif f:
            if change.to:
                edits.append((f["name_start"], f["name_end"], change.to))
            if change.raw is not None:
                edits.append((f["value_start"], f["value_end"], change.raw))
    new = [c for n, c in plan.changes.items() if n not in plan.fields and c.raw and not c.gone]
    if new:
        edits.append(_insertion(text, entry, new))
    for start, end, value in sorted(edits, key=lambda e: (-e[0], -e[1])):
        text = text[:start] + value + text[end:]
    return text


def _tidy(text: str, entry: dict, plan: _Plan) -> str:
    """Fields in order and aligned, values in braces; repeated and unknown fields and macros are kept."""
    rows: list[tuple[str, str]] = []
    done: set[str] = set()
    for name, shown, raw in plan.read.rows:
        change = plan.changes.get(name)
        if change:
            if change.gone:
                continue
            shown = change.to or shown
            if name not in done and change.raw is not None:
                raw = change.raw
        done.add(name)
        low = shown.lower()
        rows.append((low if low in _PLACE else shown, raw))
    rows += [(c.name.lower(), c.raw) for n, c in plan.changes.items() if n not in plan.fields and c.raw and not c.gone]
    rows.sort(key=lambda r: _PLACE.get(r[0].lower(), len(_PLACE)))
    width = max((len(n) for n, _ in rows), default=0)
    body = "".join(f",\n  {n.ljust(width)} = {raw}" for n, raw in rows)
    return f"@{plan.type or entry['type']}{{{plan.key if plan.key is not None else entry['key']}{body}\n}}"


def apply_changes(text: str, accepted: list[dict]) -> tuple[str, list[str], list[tuple[str, str]]]:
    """(new text, ids that were applied, (id, reason) of those that could not be)."""
    return changed(text, first_entry(text), accepted)


def first_entry(text: str) -> Entry | None:
    entry = next((i for i in parse_bibtex(text) if i["kind"] == "entry"), None)
    return Entry(text, entry) if entry else None


def changed(text: str, read: Entry | None, accepted: list[dict]) -> tuple[str, list[str], list[tuple[str, str]]]:
    """apply_changes of a text whose first entry has been read; the entry stays as it is."""
    if read is None:
        return text, [], [(s["id"], "The text is no entry") for s in accepted]
    plan, applied, skipped = _Plan(read), [], []
    for s in sorted(accepted, key=lambda s: _RANK[s["kind"]]):
        reason = plan.take(s)
        skipped += [(s["id"], reason)] if reason else []
        applied += [] if reason else [s["id"]]
    plan.wrap()
    return (_tidy if plan.layout else _patched)(text, read.entry, plan), applied, skipped


def tidied(text: str | None) -> str | None:
    return None if text is None else apply_changes(text, [{"id": "layout", "field": "ENTRY", "kind": "layout"}])[0]


tidy_layout = arrow_function(tidied, "string")


#: What a suggestion says of a change, in the order in which a citation's are sorted.
CHANGE = ("ordinal", "id", "field", "kind", "value", "term", "to")


def patched(text: str | Column, taken: str | Column) -> Column:
    """A text under an array of changes, null for none: struct (result, applied, skipped)."""

    @F.pandas_udf("struct<result:string,applied:array<string>,skipped:array<struct<id:string,reason:string>>>")
    def run(text: pd.Series, taken: pd.Series) -> pd.DataFrame:
        out = []
        for t, many in zip(text, taken):
            result, applied, skipped = apply_changes(t, list(many) if many is not None else []) if t is not None else (None, [], [])
            out.append({"result": result, "applied": applied, "skipped": [{"id": i, "reason": r} for i, r in skipped]})
        return pd.DataFrame(out, columns=["result", "applied", "skipped"])

    return run(text, taken)


def apply_suggestions(entries: DataFrame, suggestions: DataFrame) -> DataFrame:
    """entries (citation_id, text), suggestions (citation_id, ordinal, id, field, kind, value, term, to, accepted) ->
    (citation_id, text, result, applied, skipped).

    Suggestions of one citation are a few dozen; they are gathered into one row with it, in order.
    """
    taken = suggestions.filter("accepted = true").groupBy("citation_id").agg(F.sort_array(F.collect_list(F.struct(*CHANGE))).alias("taken"))

    return entries.hint("merge").join(taken, "citation_id", "left").withColumn("x", patched("text", "taken")).select("citation_id", "text", "x.*")


def diff_lines(a: str | None, b: str | None) -> list[dict[str, str]]:
    """Lines that stay, go and come, by a longest common subsequence; of equal choices the old line goes first."""
    old, new = (a or "").split("\n"), (b or "").split("\n")
    n, m = len(old), len(new)
    gone, come = ([{"kind": k, "text": t} for t in lines] for k, lines in (("del", old), ("add", new)))
    if n * m > DIFF_CELLS:
        return gone + come
    best = [[0] * (m + 1)]
    for line in reversed(old):
        below, row = best[-1], [0] * (m + 1)
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if line == new[j] else max(below[j], row[j + 1])
        best.append(row)
    best.reverse()
    out, i, j = [], 0, 0
    while i < n and j < m:
        if old[i] == new[j]:
            out.append({"kind": "same", "text": old[i]})
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(gone[i])
            i += 1
        else:
            out.append(come[j])
            j += 1
    return out + gone[i:] + come[j:]


line_diff = arrow_function(diff_lines, "array<struct<kind:string,text:string>>")


def diff_text(diff: str | Column) -> Column:
    mark = lambda d: F.when(d["kind"] == "same", " ").when(d["kind"] == "add", "+").otherwise("-")
    return F.array_join(F.transform(diff, lambda d: F.concat(mark(d), F.lit(" "), d["text"])), "\n")
