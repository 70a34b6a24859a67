"""What a trial costs: a citation's text is read once for all its trials, and plain fields are read in one step."""

import random
import re

from recordcheck.operators import trials as module
from recordcheck.sources import bibtex


def suggestion(n, field, value, kind="set"):
    return {"ordinal": n, "id": f"s{n}", "field": field, "kind": kind, "value": value, "term": None, "to": None}


def test_a_text_is_read_once_for_all_trials(monkeypatch):
    text, read = "@misc{k, year = 2001, note = {x}}", []
    monkeypatch.setattr(module, "parse_bibtex", lambda t: read.append(t) or bibtex.parse_bibtex(t))
    every = [suggestion(0, "year", "2002"), suggestion(1, "note", "y"), suggestion(2, "KEY", "z")]
    got = list(module._tried(text, every, ["s0", "s1"], []))
    assert [(t, s and s["id"], changed) for t, s, _, _, changed in got] == [
        ("alone", "s0", ["year"]), ("without", "s0", ["KEY", "note"]), ("alone", "s1", ["note"]), ("without", "s1", ["KEY", "year"]),
        ("alone", "s2", ["KEY"]), ("without", "s2", ["note", "year"]), ("bulk", None, ["note", "year"]), ("none", None, []),
    ]
    assert read == [text]


def test_plain_fields_as_step_by_step(monkeypatch):
    r = random.Random(5)
    pieces = ["{", "}", "(", ")", '"', "#", ",", "=", " ", "\n", "@book{k,", "@misc(k,", "x = {y}", "year = 12", "12ab", ' t = "q"', "},", "@string{s = {v}}", 's # "b"', "author = {A {B} c},", "\x0b", "\xa0"]
    texts = ["@book{k, " * r.randint(0, 1) + "".join(r.choice(pieces) for _ in range(r.randint(1, 20))) for _ in range(4000)]
    limits = bibtex.Limits(), bibtex.Limits(fields=2, field_chars=4, entry_chars=30, depth=2)
    fast = [bibtex.parsed_rows(t, limit) for t in texts for limit in limits]
    monkeypatch.setattr(bibtex, "_PLAIN_FIELD", re.compile("(?!)"))
    assert [bibtex.parsed_rows(t, limit) for t in texts for limit in limits] == fast
    parts = [bibtex.first_parts(t, limit) for t in texts for limit in limits]
    monkeypatch.undo()
    assert [bibtex.first_parts(t, limit) for t in texts for limit in limits] == parts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_over_a_given_number_of_tasks(spark):
    parsed = bibtex.items(spark.range(60).selectExpr("id", "concat('@misc{k', id, '}') AS text").coalesce(1), "id")
    assert "REPARTITION_BY_NUM" in plan(parsed) and parsed.count() == 60


def test_rules_parse_their_entries_once(spark, monkeypatch):
    from oracle import SF

    from recordcheck.plans import queries_rules

    class Seen(Exception):
        pass

    def look(entries, fields):
        assert "MapInArrow" not in plan(entries) + plan(fields)
        raise Seen

    monkeypatch.setattr(queries_rules, "build_citations", look)
    for made in (queries_rules._evaluated, queries_rules._evaluated_more):
        try:
            made(spark, SF)
        except Seen:
            continue
        raise AssertionError("the citations were not built")


def test_braces_in_braces_are_read_in_one_step(monkeypatch):
    """Plain entries, and ones with braces one deep, are not read step by step, and are read as step by step."""
    r = random.Random(6)
    pieces = ["{", "}", "{x}", "{{y} z}", "{a {b} c}", '"', "#", ",", "=", " ", "\n", "x = {y}", "x = {}", "year = 12", "},", "title = {{Python} and {C} in {{d}}},", "author = {A {B} c},", '\\{', 't = "q"', ")"]
    texts = ["@book{k, " + "".join(r.choice(pieces) for _ in range(r.randint(1, 12))) + "}" for _ in range(6000)]
    limits = bibtex.Limits(), bibtex.Limits(fields=2, field_chars=6, entry_chars=40, depth=2), bibtex.Limits(depth=1)
    fast = [(bibtex.first_parts(t, limit), bibtex.parsed_rows(t, limit)) for t in texts for limit in limits]
    monkeypatch.setattr(bibtex, "_PLAIN_FIELD", re.compile("(?!)"))
    assert [(bibtex.first_parts(t, limit), bibtex.parsed_rows(t, limit)) for t in texts for limit in limits] == fast
    monkeypatch.undo()
    monkeypatch.setattr(bibtex, "parsed_rows", lambda *_: [])
    assert bibtex.first_parts("@misc{k, title = {In {Python} and {C}}, year = 2001,\n}") == {"title": "In {Python} and {C}", "year": "2001", "KEY": "k", "ENTRYTYPE": "misc"}


def test_only_wanted_columns_of_trials_are_made(spark):
    made = "ordinal long, id string, field string, kind string, value string, term string, to string, category string, grp string, accepted boolean"
    rows = [(1, 0, "s0", "year", "set", "2002", None, None, "conflict", None, None), (1, 1, "s1", "KEY", "set", "z", None, None, "key", None, None), (2, 0, "s0", "note", "remove", None, None, None, "missing", None, None)]
    suggestions = spark.createDataFrame(rows, "citation_id long, " + made)
    entries = spark.createDataFrame([(1, "@misc{k, year = 2001}"), (2, "@misc{k, note = {x}}"), (3, "@misc{k}")], "citation_id long, text string")
    whole = module.trials(entries, suggestions)
    few = module.trials(entries, suggestions, ("trial", "field", "changed"))
    assert few.columns == ["citation_id", "trial", "field", "changed"]
    got = sorted(map(repr, few.collect()))
    assert got == sorted(map(repr, whole.select(*few.columns).collect())) and len(got) == 10
