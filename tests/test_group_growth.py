"""Grouping of records: titles that many records share, in as many years, are not compared pairwise."""

import itertools
import random

import duckdb
from oracle import SF, TABLES, same_rows
from pyspark.sql import functions as F

from recordcheck.functions.authors import compare_author_keys
from recordcheck.operators import candidates
from recordcheck.operators.score import same_record, work_keys
from recordcheck.plans.queries import ORACLE_SQL, QUERIES
from recordcheck.plans.queries_match import from_source, person, work


def _spread(spark, titles, years):
    rows = spark.createDataFrame([(1, pos, t, y) for pos, (t, y) in enumerate(itertools.product(titles, years))], "citation_id long, pos long, t string, y int")
    return rows.select("citation_id", "pos", work(title=F.col("t"), year=F.col("y"), sources=from_source("Crossref")).alias("work"))


def test_pairs_of_classes_follow_the_classes(spark, monkeypatch):
    """Two titles that share most words but are not alike, each of 60 years."""
    seen = {}

    def keep(df, label, **more):
        seen[label] = back = store(df, label, **more)
        return back

    store = candidates.stored
    monkeypatch.setattr(candidates, "stored", keep)
    rows = _spread(spark, ["blue bolt of the large kind", "blue gear of the large kind"], range(1950, 2010))
    groups = candidates.group_records(rows).groupBy("group").count().collect()
    assert seen["class-pairs"].count() <= 2 * 60
    assert sum(x["count"] for x in groups) == 60 and len(groups) == 60  # of one title each second year is a twin in the group of the year before


def test_record_pairs_miss_no_match(spark):
    """Against all pairs: DOIs, arXiv ids, preprints, years that are missing or 0, similar titles and ones that begin others."""
    r = random.Random(7)
    titles = ["a study of the blue bolt in winter light", "a study of the blue bolt in winter lights", "a study of the blue bolt in winter light and more", "other work on gears", "", None]
    made = [
        (c, n, r.choice(titles), r.choice([None, 0, 1999, 2000, 2001, 2003]), r.choice([None, None, "10.5555/a", "10.5555/b", "none"]), r.choice([None, None, "2401.00001"]), r.random() < 0.3, r.choice(["Doe", "Roe", None]))
        for c in range(2) for n in range(45)
    ]
    rows = spark.createDataFrame(made, "citation_id long, class int, t string, y int, d string, x string, p boolean, n string")
    authors = F.when(F.col("n").isNotNull(), F.array(person(F.col("n"), "Jo"))).otherwise(F.array())
    w = work(title=F.col("t"), year=F.col("y"), doi=F.col("d"), arxiv_id=F.col("x"), is_preprint=F.col("p"), authors=authors)
    rows = candidates.stored(work_keys(rows.select("citation_id", "class", w.alias("work"))).select("citation_id", "class", "k"), "test")
    a, b = (rows.select("citation_id", F.col("class").alias(i), F.col("k").alias(k)) for i, k in (("i", "a"), ("j", "b")))
    both = a.join(b, "citation_id").filter("i <> j").withColumn("authors", compare_author_keys(F.col("a.authors"), F.col("b.authors"), F.lit(False)))
    want = {(x["citation_id"], x["i"], x["j"]) for x in both.filter(same_record(F.col("a"), F.col("b"), F.col("authors"))).collect()}
    met = {tuple(x) for x in candidates.record_pairs(rows, "class").collect()}
    assert len(want) > 100 and {(c, min(i, j), max(i, j)) for c, i, j in want} <= met and all(i < j for _, i, j in met)
    got = {(x["citation_id"], i, x["class"]) for x in candidates._class_matches(rows).collect() for i in x["matches"] if i != x["class"]}
    assert got == want


def test_groups_of_few_titles_in_many_years(spark, tmp_path):
    part = f"""SELECT i AS p_partkey, ['old bolt', 'old bolts', 'cold gear', 'cold gears with a rather long name', 'cold gears with a rather long names'][(hash(i) % 5 + 1)::INT] AS p_name,
      'Brand#' || (hash(i + 9999) % 2) AS p_brand, ['LARGE', 'SMALL'][(hash(i + 99999) % 2 + 1)::INT] AS p_type, (hash(i + 999999) % 50 + 1)::INTEGER AS p_size FROM (SELECT unnest(range(400)) AS i)"""
    for t in TABLES:
        duckdb.execute(f"COPY ({part if t == 'part' else f'''SELECT * FROM '{SF}/{t}.parquet' LIMIT 1'''}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    same_rows(spark, QUERIES["group_works"], ORACLE_SQL["group_works"], str(tmp_path))
