"""The BibTeX data source: files cut into ranges of any size, and files that are written."""

import io
import os
import random
import tempfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordcheck.sources import bibfiles
from recordcheck.sources.bibfiles import Range, planned, range_items, read_bibtex, shifted, write_bibtex
from recordcheck.sources.bibtex import Limits, parse_bibtex

SIGNS = ["@", "@a{k, t = {", "@b(k, n = 1)", "@{", "}", "(", ")", '"', ",", "=", "#", "key", "title", "\n", "\n@", " ", "é", "😀", "@string{s = {x}}\n", "\n@misc{m, note = {a} # b}\n", "mail a@b.org ", "@comment{x}", '@preamble{"p"}', "\n@a{long, t = {" + "y" * 70 + "}}\n"]


def read_in_ranges(text, size, limits):
    """Items of all ranges with the positions of the file, free text joined."""
    data, out, chars, lines, pos = text.encode(), [], 0, 0, 0
    cuts = [*range(0, len(data), size), len(data)] if data else [0, 0]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for item in range_items(io.BytesIO(data), Range("f", k, a, b, len(data)), limits):
            if item["kind"] == "range":
                chars, lines, pos = chars + item["chars"], lines + item["lines"], pos + item["pos"]
            else:
                item = shifted(item, chars) | {"pos": pos + item["pos"]}
                out.append(item | ({"line": item["line"] + lines} if item["kind"] == "error" else {}))
    assert chars == len(text) and [i["pos"] for i in out] == list(range(pos))
    return out


def test_ranges_of_any_size_give_the_same_items():
    r, limits, errors = random.Random(5), Limits(entry_chars=60), 0
    for n in range(150):
        text = "".join(r.choice(SIGNS) for _ in range(r.randint(0, 60)))
        whole = read_in_ranges(text, 1 << 20, limits)
        errors += sum(i["kind"] == "error" for i in whole)
        for size in (1, 7, 40, 200):
            assert read_in_ranges(text, size, limits) == whole, (n, size, text)
    assert errors > 500


def test_items_are_those_of_the_parser():
    r, alike = random.Random(6), 0
    for _ in range(200):
        text = "".join(r.choice(SIGNS) for _ in range(r.randint(0, 40)))
        ours = [i for i in read_in_ranges(text, 30, Limits(entry_chars=100_000)) if i["kind"] != "comment" or i["text"].startswith("@comment")]
        theirs = [i | {"pos": None} for i in parse_bibtex(text) if i["kind"] != "comment" or i["text"].startswith("@comment")]
        assert [i | {"pos": None} for i in ours] == theirs
        alike += len(ours)
    assert alike > 1000


def test_text_that_is_quoted_across_ranges():
    """Whole entries within a value, and an error whose next sign is far behind."""
    inner = "\n@book{inner, title = {no entry}}\n" * 40
    text = "@misc{outer, note = {" + inner + "}}\n@book{after, title = {x}}\n@a{open, t = {" + "w@x.org foo@book{z, t = {1}} " * 40 + "\n@misc{last}"
    for limits in (Limits(), Limits(entry_chars=500)):
        whole = read_in_ranges(text, 1 << 20, limits)
        for size in (13, 100, 999):
            assert read_in_ranges(text, size, limits) == whole
    assert [i["key"] for i in read_in_ranges(text, 50, Limits()) if i["kind"] == "entry"] == ["outer", "after", "last"]


def test_plan():
    plan = planned(iter([("a", 10), ("b", 250), ("c", 20), ("d", 95)]), 100, 100)
    assert [[(r.file_id, r.begin, r.end) for r in p.ranges] for p in plan] == [[("b", 0, 100)], [("b", 100, 200)], [("b", 200, 250)], [("a", 0, 10), ("c", 0, 20)], [("d", 0, 95)]]


def test_source_and_sink(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="bibtex-")
    text = "".join(f"% é {k}\n@book{{k{k}, title = {{T{k}}}, note = s # {{\n}}}}\nbroken @a{{ x y\n" for k in range(60))
    rows = [("one", text), ("one", "@misc{z}"), ("two/x", "@misc{y}\n"), (None, "@misc{n}"), ("gone", None)]
    write_bibtex(spark.createDataFrame(rows, "key string, text string"), f"file://{folder}")
    assert sorted(os.listdir(folder)) == ["_SUCCESS", "entry.bib", "one.bib", "two_x.bib"] and open(f"{folder}/_SUCCESS").read() == "4"
    content = open(f"{folder}/one.bib").read()
    assert sorted(content.split("@misc{z}\n")) == ["", text]
    order = ["file_id", "pos"]
    plain = read_bibtex(spark, f"file://{folder}", 1 << 20).orderBy(*order).toPandas()
    want = parse_bibtex(content)
    of_one = plain[plain.file_id.str.endswith("one.bib")]
    assert [(i["kind"], i["start"], i.get("line")) for i in want] == [(k, s, None if n != n else n) for k, s, n in zip(of_one.kind, of_one.start, of_one.line)]
    for size in (64, 700):
        cut = read_bibtex(spark, f"file://{folder}", size, wholeBytes=0).filter("kind <> 'comment'").drop("pos").orderBy("file_id", "start").toPandas()
        same = plain[plain.kind != "comment"].drop(columns="pos").sort_values(["file_id", "start"]).reset_index(drop=True)
        assert repr(cut.values.tolist()) == repr(same.values.tolist())
    # a failed job leaves what is there, and nothing else
    bad = F.when(F.col("key") == "two/x", F.raise_error(F.lit("no"))).otherwise(F.col("text"))
    with pytest.raises(PySparkException):
        write_bibtex(spark.createDataFrame(rows, "key string, text string").withColumn("text", bad), f"file://{folder}")
    assert sorted(os.listdir(folder)) == ["_SUCCESS", "entry.bib", "one.bib", "two_x.bib"]
    spark.dataSource.register(bibfiles.BibtexSource)
    with pytest.raises(PySparkException, match="two tasks wrote one file"):
        spark.createDataFrame([("a.bib", "@a{x}"), ("a.bib", "@a{y}")], "file string, text string").repartition(2).write.format("bibtex").mode("append").save(f"file://{folder}")
    write_bibtex(spark.createDataFrame([("new", "@a{x}")], "key string, text string"), f"file://{folder}")
    assert sorted(os.listdir(folder)) == ["_SUCCESS", "new.bib"]
