"""Trials of suggestions against changes applied one text at a time."""

import random

from recordcheck.operators.apply import apply_changes
from recordcheck.operators.trials import changed_names, trials, violations
from recordcheck.sources.bibtex import parse_bibtex

SUGGESTIONS = "citation_id long, ordinal int, id string, field string, kind string, value string, term string, to string, category string, grp string, accepted boolean"
TEXTS = [
    "@article{k1,\n  title = {Deep Parsing of {JSON} Files},\n  Year = 2001,\n  note = jan # {x},\n  note = {again}\n}",
    '% kept\n@misc{k2, title = "A Title", howpublished = {here}, mynote={keep me},}',
    "@book(k3, author = {A and B}, year = {2003})",
    "no entry here",
    None,
]


def some(r, n):
    field, kind = r.choice(["title", "year", "note", "doi", "KEY", "ENTRYTYPE", "ENTRY", "howpublished"]), r.choice(["set", "set", "remove", "rename", "wrap"])
    kind = "layout" if field == "ENTRY" else "set" if field.isupper() else kind
    return {"ordinal": n, "id": f"s{n}", "field": field, "kind": kind, "value": r.choice(["2001", "new", "A Title"]), "term": r.choice(["Parsing", "Title"]), "to": r.choice(["year", "series"]), "category": r.choice(["conflict", "format", "key", "version"]), "grp": r.choice([None, None, "g"])}


def bulk(many):
    """What bulk acceptance takes: no key or version; of a group the first."""
    taken, groups = [], set()
    for s in many:
        if s["category"] in ("key", "version") or s["grp"] in groups:
            continue
        groups |= {s["grp"]} - {None}
        taken.append(s)
    return taken


def test_against_one_text_at_a_time(spark):
    r = random.Random(11)
    entries, rows, want = [], [], {}
    for c in range(60):
        text = TEXTS[c % len(TEXTS)]
        many = [some(r, n) for n in range(r.randint(0, 6))]
        entries.append((c, text))
        rows += [(c, *(s[k] for k in ("ordinal", "id", "field", "kind", "value", "term", "to", "category", "grp")), r.choice([None, True, False])) for s in many]
        if text is None or not many:
            continue
        sets = {("none", None): [], ("bulk", None): bulk(many)}
        for s in many:
            sets["alone", s["id"]] = [s]
            sets["without", s["id"]] = [x for x in many if x is not s]
        for key, taken in sets.items():
            want[c, *key] = apply_changes(text, taken)[:2]
    tried = trials(spark.createDataFrame(entries, "citation_id long, text string"), spark.createDataFrame(rows, SUGGESTIONS))
    got = {(x["citation_id"], x["trial"], x["id"]): x for x in tried.collect()}
    assert {k: (x["result"], x["applied"]) for k, x in got.items()} == want
    assert all(x["changed"] == changed_names(x["text"], x["result"]) for x in got.values())
    broken = {(x["citation_id"], x["trial"], x["id"]): x["rule"] for x in violations(tried).collect()}
    assert {k for k in broken if k[1] == "alone"} >= {k for k, x in got.items() if k[1] == "alone" and x["applied"] and x["result"] == x["text"]}
    assert not {k for k in broken if k[1] in ("none", "without")}


def test_changed_names():
    text = TEXTS[0]
    assert changed_names(text, text) == [] == changed_names(None, None)
    assert changed_names(text, text.replace("2001", "{2001}")) == []
    assert changed_names(text, text.replace("k1", "K1").replace("@article", "@book").replace("{x}", "{y}")) == ["ENTRYTYPE", "KEY", "note"]
    assert changed_names(text, text.replace("Year = 2001,", "year = 2002, doi = {x},")) == ["doi", "year"]
    assert [i["kind"] for i in parse_bibtex(text)] == ["entry"]


def test_empty(spark):
    none = trials(spark.createDataFrame([], "citation_id long, text string"), spark.createDataFrame([], SUGGESTIONS))
    assert none.count() == 0 == violations(none).count()
