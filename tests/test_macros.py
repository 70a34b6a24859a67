"""Macros expanded by joins, against the expansion of one text at a time."""

import random

from pyspark.sql import functions as F

from recordcheck.sources.bibtex import fields, items, parse_bibtex, strings, value_text
from recordcheck.sources.macros import items_with_definitions, with_definitions


def some_file(r):
    names = ["a", "B", "c", "jan", "Feb", "Dd", "e1", "f", "g", "h", "k", "lib1", "Lib2", "lib3"]
    value = lambda: " # ".join(r.choice(["{t}", '"q"', "7", r.choice(names), r.choice(names)]) for _ in range(r.choice((1, 1, 2))))
    text = "".join(f"@string{{{r.choice(names)} = {value()}}}\n" for _ in range(r.randint(0, 9)))
    return text + "".join(f"@misc{{k{n}, x = {value()}, y = {value()}}}\n" for n in range(3)) + f"@string{{{r.choice(names)} = {value()}}}"


def test_fields_as_one_text_at_a_time(spark):
    r = random.Random(9)
    files = [(f"f{n}", f"L{n % 3}", some_file(r)) for n in range(40)] + [("chain", "L0", "".join(f"@string{{c{k} = {{{k}}} # c{k + 1}}}" for k in range(10)) + "@misc{x, n = c0, m = c2, o = loop}@string{loop = {o} # Loop}")]
    libraries = [(f"L{n}", "".join(f"@string{{lib{k} = {{L{n}}} # lib{k + 1} # a}}" for k in range(1, 5)) + "@string{b = {B}}") for n in range(3)]
    parsed = items(spark.createDataFrame([(f, t) for f, _, t in files], "file_id string, text string"))
    own = strings(parsed)
    library = strings(items(spark.createDataFrame(libraries, "file_id string, text string"))).withColumnRenamed("file_id", "library")
    links = spark.createDataFrame([(f, lib) for f, lib, _ in files], "file_id string, library string")
    defined = lambda text: {i["name"].lower(): i["parts"] for i in parse_bibtex(text) if i["kind"] == "string"}
    texts = dict(libraries)
    for context in (False, True):
        want = {}
        for f, lib, text in files:
            known = (defined(texts[lib]) if context else {}) | defined(text)
            for pos, i in enumerate(parse_bibtex(text)):
                for k, field in enumerate(i.get("fields") or ()):
                    want[f, pos, k] = value_text(field["parts"], known)
        got = with_definitions(fields(parsed), own, *((library, links) if context else ()))
        assert {(x["file_id"], x["pos"], x["field_pos"]): (x["text"], x["unresolved"]) for x in got.collect()} == want
        if not context:
            continue
        again = fields(items_with_definitions(parsed, *((library, links) if context else ())))
        assert {(x["file_id"], x["pos"], x["field_pos"]): (x["text"], x["unresolved"]) for x in again.collect()} == want
    one = with_definitions(fields(parsed), own, library.filter("library = 'L1'").drop("library"))
    assert one.filter(F.array_contains("unresolved", "lib5")).count() > 0
    assert with_definitions(fields(parsed.limit(0)), own.limit(0)).count() == 0


def test_equal_definitions_are_expanded_once_and_none_are_broadcast(spark, monkeypatch):
    """60 files of two libraries with two small sets of definitions of their own, a large one, or none: small ones and none are six scopes; the library's texts and what was
    found before are no broadcast but where they were counted."""
    from recordcheck.sources import macros

    own = ["", "@string{m2 = {A}}", "@string{m2 = {B} # m3}", "@string{x = m1}" + "".join(f"@string{{y{k} = {{long enough}}}}" for k in range(getattr(macros, "SCOPE_DEFINITIONS", 64)))]
    files = [(n, n % 2, f"@misc{{k, a = m1, b = x # {{ {n}}}}}" + own[n // 2 % 4]) for n in range(60)]
    libraries = [(n, "".join(f"@string{{m{k} = {{{n}}} # m{k + 1}}}" for k in range(1, 5))) for n in range(2)]
    parsed = items(spark.createDataFrame([(f, t) for f, _, t in files], "file_id long, text string"))
    library = strings(items(spark.createDataFrame(libraries, "file_id long, text string"))).withColumnRenamed("file_id", "library")
    links = spark.createDataFrame([(f, lib) for f, lib, _ in files], "file_id long, library long")
    seen, plans, store = {}, [], macros.stored

    def keep(df, label, **more):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        seen[label] = back = store(df, label, **more)
        return back

    monkeypatch.setattr(macros, "stored", keep)
    monkeypatch.setattr(macros, "SMALL_ROWS", 0, raising=False)
    got = with_definitions(fields(parsed), strings(parsed), library, links).collect()
    defined = lambda text: {i["name"].lower(): i["parts"] for i in parse_bibtex(text) if i["kind"] == "string"}
    texts = dict(libraries)
    for x in got:
        _, lib, text = files[x["file_id"]]
        parts = next(i for i in parse_bibtex(text) if i["kind"] == "entry")["fields"][x["field_pos"]]["parts"]
        assert (x["text"], x["unresolved"]) == value_text(parts, defined(texts[lib]) | defined(text))
    assert len(got) == 120
    assert seen["macro-definitions"].filter("name = 'm1'").count() == 6 + 14  # a file of many definitions is by itself
    assert sum(label == "macro-found" for label, _ in plans) > 3 and not [label for label, plan in plans if "BroadcastHashJoin" in plan]
