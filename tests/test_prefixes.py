"""Texts that begin others, against all pairs."""

import random

from pyspark.sql import functions as F

from recordcheck.functions.text import title_similarity
from recordcheck.operators.prefixes import prefix_pairs
from recordcheck.sources.lookups import search_titles


def test_pairs_are_those_of_all_pairs(spark):
    r = random.Random(4)
    make = lambda: "".join(r.choice("ab😀 ") for _ in range(r.randint(0, 9)))
    left, right = [make() for _ in range(300)] + [None, "abab", "abab"], [make() for _ in range(300)] + ["", "abab" * 3, None]
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    for least, part in ((1, 7), (3, 50), (1, 10_000)):
        want = {(a, b) for a in left for b in right if a and b and min(len(a), len(b)) >= least and (a.startswith(b) or b.startswith(a))}
        got = [(x["a"], x["b"]) for x in prefix_pairs(frame(left), frame(right), least, part).collect()]
        assert set(got) == want and len(got) == len(want)
    assert prefix_pairs(frame([]), frame(right)).count() == 0


def test_many_titles_of_one_head(spark):
    """Ten thousand titles begin alike, and with two that are asked for: pairs are as many as hits, not as titles squared."""
    head = "proceedings of the conference on "
    works = [f"{head}topic {k} {k * 7919 % 10_007}" for k in range(10_000)]
    frame = lambda texts, name: spark.createDataFrame([(t,) for t in texts], f"{name} string")
    asked = [head.strip(), head + "topic 77", head + "nothing", "short"] + works[:2000]
    want = sum(w.startswith(a) or a.startswith(w) for a in asked[:4] for w in works) + 2000
    pairs = prefix_pairs(frame(asked, "text"), frame(works, "text"), 20, 1000)
    assert pairs.count() == want < 13_000
    few = frame(asked[:4], "norm_title").withColumn("citation_id", F.col("norm_title"))
    hits = search_titles(few, frame(works, "norm_title").withColumn("work", F.struct(F.col("norm_title").alias("title"))), 20_000, 0.9)
    every = few.select("citation_id").crossJoin(frame(works, "title")).filter(title_similarity(F.col("citation_id"), F.col("title")) >= 0.9)
    found = {(r["citation_id"], r["work"]["title"]) for r in hits.collect()}
    assert found == {tuple(r) for r in every.collect()} and sum(a == head.strip() for a, _ in found) == 10_000
