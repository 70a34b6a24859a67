"""Work that is done once for what repeats: titles that many citations share, and texts that are read more than once."""

import duckdb
from oracle import SF, same_rows
from pyspark.sql import functions as F
from test_growth import plan

from recordcheck.operators.citations import build_citations
from recordcheck.operators.evaluate import title_inner
from recordcheck.plans.queries import ORACLE_SQL, QUERIES
from recordcheck.sources.bibtex import entries, fields, items
from recordcheck.sources.lookups import search_titles
from recordcheck.storage import stored


def test_entries_are_parsed_once_for_their_candidates(spark):
    assert "MapInArrow" not in plan(QUERIES["entry_candidates"](spark, SF))


def test_works_are_placed_once_for_each_title(spark):
    titles = ["red apple pie", "red apple tart", "red apple cake", "blue plum pie", None, ""]
    wanted = spark.createDataFrame([(k, titles[k % len(titles)]) for k in range(60)], "citation_id long, norm_title string")
    works = spark.createDataFrame([(t, v) for t in titles[:4] for v in "ab"], "norm_title string, venue string").select(F.struct(F.col("norm_title").alias("title"), "venue").alias("work"), "norm_title")
    hits = search_titles(wanted, works, 3, 0.55)
    windows = [line for line in plan(hits).splitlines() if " Window " in line or "WindowGroupLimit" in line]
    assert windows and all("title_a" in line and "citation_id" not in line for line in windows)
    got: dict = {}
    for x in hits.collect():
        got.setdefault(x["citation_id"], []).append((x["place"], x["work"]["title"], x["work"]["venue"], round(x["similarity"], 6)))
    assert sorted(got) == [k for k in range(60) if titles[k % len(titles)]]
    for k, found in got.items():
        assert sorted(found) == sorted(got[k % len(titles)]) and [x[0] for x in sorted(found)] == list(range(1, len(found) + 1))
        assert {x[1] for x in found if x[0] <= 2} == {titles[k % len(titles)]} and len(found) == (3 if k % len(titles) < 3 else 2)


def test_candidates_of_repeated_parts(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT p_partkey + k * 1000 AS p_partkey, * EXCLUDE (p_partkey) FROM '{SF}/part.parquet', (SELECT unnest(range(5)) AS k)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    from oracle import TABLES

    for t in TABLES:
        if t != "part":
            duckdb.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet' LIMIT 1) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    same_rows(spark, QUERIES["entry_candidates"], ORACLE_SQL["entry_candidates"], str(tmp_path))


def _cited(spark, *texts):
    parsed = stored(items(spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")), "parsed")
    return build_citations(entries(parsed), fields(parsed))


def test_own_fields_are_read_without_a_shuffle(spark):
    cited = _cited(spark, "@misc{a, Title = {X}, title = {Y}, NOTE = {n}}", "@misc{b}", '@string{s = "S"} @misc{c, series = s # {!}, crossref = {}}')
    assert "Exchange" not in plan(cited)
    got = {x["key"]: (x["f"], x["own"], x["inherited"]) for x in cited.collect()}
    assert got == {"a": ({"title": "X", "note": "n"}, ["note", "title"], []), "b": ({}, [], []), "c": ({"series": "S!", "crossref": ""}, ["crossref", "series"], [])}


def test_few_entries_that_name_others(spark):
    child = "@inproceedings{a, title = {X}, year = 2001, CrossRef = {P}, crossref = {none}, xdata = {q, p}}"
    cited = _cited(spark, child + "@proceedings{p, title = {All}, year = 1999, publisher = {H}}@xdata{Q, publisher = {other}, volume = 7}", "@proceedings{p, title = {Else}}@misc{z, note = {n}}")
    got = {(x["file_id"], x["key"]): (x["f"], x["own"], x["inherited"]) for x in cited.collect()}
    own = {"title": "X", "year": "2001", "crossref": "P", "xdata": "q, p"}
    assert got[0, "a"] == (own | {"booktitle": "All", "publisher": "H", "volume": "7"}, ["crossref", "title", "xdata", "year"], ["booktitle", "publisher", "volume"])
    assert got[0, "p"] == ({"title": "All", "year": "1999", "publisher": "H"}, ["publisher", "title", "year"], [])
    assert got[1, "p"] == ({"title": "Else"}, ["title"], []) and got[1, "z"] == ({"note": "n"}, ["note"], []) and len(got) == 5


def test_title_without_python(spark):
    texts = ["@misc{a, note = {n}, TITLE = {In {B}races}, title = {later}}", '@misc{b, title = "Quoted"}', "@misc{c, title = {x} # {y}}", "@misc{d, title = jan}", "@misc{e, note = {n}}", "@misc{f, title = {}}"]
    rows = entries(stored(items(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "file_id long, text string")), "parsed")).select("key", title_inner(F.col("fields")).alias("inner"))
    assert "Python" not in plan(rows)
    assert dict(map(tuple, rows.collect())) == {"a": "In {B}races", "b": "Quoted", "c": None, "d": None, "e": None, "f": ""}
