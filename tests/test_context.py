"""Entries with the context of their list, against a reading of one text at a time."""

import random

from recordcheck.operators.citations import build_citations
from recordcheck.sources.bibtex import entries, fields, inherited_fields, items, parse_bibtex, value_text
from recordcheck.sources.context import Context, items_in_context, parents_in_context


def plain(text, listed):
    """name -> (text, inherited) of the first entry of a text."""
    defined = lambda read: {i["name"].lower(): i["parts"] for i in read if i["kind"] == "string"}
    read, around = parse_bibtex(text), parse_bibtex(listed)
    known = defined(around) | defined(read)
    entry = next(i for i in read if i["kind"] == "entry")
    shown = lambda f: value_text(f["parts"], known)[0]
    own = {}
    for f in entry["fields"]:
        own.setdefault(f["name"].lower(), (shown(f), False))
    out = dict(own)
    refs = [r.strip().lower() for n in ("crossref", "xdata") for r in own.get(n, ("",))[0].split(",") if r.strip()]
    for ref in refs:
        parent = next((i for i in around if i["kind"] == "entry" and i["key"].lower() == ref), None)
        for f in parent["fields"] if parent else ():
            name = f["name"].lower()
            name = "booktitle" if name == "title" and parent["type"] != entry["type"] else name
            out.setdefault(name, (shown(f), True))
    return out


def some(r):
    names = ["a", "B", "jan", "m1", "M2", "m3"]
    value = lambda: " # ".join(r.choice(["{t}", '"q"', r.choice(names), str(r.randint(1, 9))]) for _ in range(r.choice((1, 2))))
    define = lambda: f"@string{{{r.choice(names)} = {value()}}}\n"
    ref = lambda: r.choice(["{k1}", "{K2, none}", "{k2,,K3}", "to", "{}", "{k9}"])
    body = lambda: "".join(f", {n} = {value()}" for n in r.sample(["title", "Title", "year", "booktitle", "note", "publisher"], r.randint(0, 4)))
    kind = lambda: r.choice(["book", "inbook"])
    listed = "".join([define() for _ in range(3)] + [f"@{kind()}{{{r.choice('kK')}{r.randint(1, 3)}{body()}}}\n" for _ in range(5)] + ["@string{to = {k1, k3}}"])
    text = "".join([define() for _ in range(r.randint(0, 2))]) + f"@{kind()}{{x{body()}, crossref = {ref()}, xdata = {ref()}}}"
    return text, listed


def test_against_one_text_at_a_time(spark):
    r = random.Random(3)
    made = [(n, *some(r)) for n in range(60)]
    shared = made[0][2]  # a third of the texts come from one list
    made = [(n, text, shared if n % 3 == 0 else listed, 0 if n % 3 == 0 else n) for n, text, listed in made]
    library = items(spark.createDataFrame(sorted({(lib, listed) for _, _, listed, lib in made}), "file_id long, text string"))
    links = spark.createDataFrame([(n, lib) for n, _, _, lib in made], "file_id long, library long")
    context = Context(library, links)
    parsed = items_in_context(items(spark.createDataFrame([(n, t) for n, t, _, _ in made], "file_id long, text string")), context)
    parents = parents_in_context(parsed, context)
    got = {n: {} for n, *_ in made}
    for row in sorted(fields(parsed).collect(), key=lambda x: x["field_pos"]):
        got[row["file_id"]].setdefault(row["name"].lower(), (row["text"], False))
    for row in inherited_fields(fields(parsed), parents).collect():
        assert row["name"] not in got[row["file_id"]]
        got[row["file_id"]][row["name"]] = (row["text"], True)
    assert got == {n: plain(text, listed) for n, text, listed, _ in made}
    assert sum(i for fields_ in got.values() for _, i in fields_.values()) > 40
    cited = build_citations(entries(parsed), fields(parsed), parents)
    assert {x["file_id"]: x["inherited"] for x in cited.select("file_id", "inherited").collect()} == {n: sorted(k for k, (_, i) in got[n].items() if i) for n in got}


def test_no_list(spark):
    parsed = items(spark.createDataFrame([(1, "@misc{a, note = m, crossref = {b}}"), (2, ""), (3, None)], "file_id long, text string"))
    context = Context(items(spark.createDataFrame([], "file_id long, text string")), spark.createDataFrame([], "file_id long, library long"))
    read = items_in_context(parsed, context)
    assert [(x["name"], x["text"], x["unresolved"]) for x in fields(read).orderBy("field_pos").collect()] == [("note", "m", ["m"]), ("crossref", "b", [])]
    assert parents_in_context(read, context).count() == 0
