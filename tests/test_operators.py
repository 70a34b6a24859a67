"""Matching, review, lookups, caching and the whole run."""

import json
import random

from pyspark.sql import functions as F

from recordcheck.functions.titles import free_key, keys_by_stem
from recordcheck.operators.candidates import first_fit, seed_labels
from recordcheck.operators.evaluate import check_rows, comparison_rows, suggestion_rows
from recordcheck.operators.review import accept_all, decide
from recordcheck.plans.analyze import Sources, analyze
from recordcheck.schema import WORK
from recordcheck.sources.cache import cache_fold
from recordcheck.sources.lookups import SnapshotSource, with_norm_title
from recordcheck.sources.payloads import map_crossref, map_dblp


def test_first_fit_is_greedy(spark):
    item = "array<struct<place:int,same:array<int>,twin:array<int>>>"
    chain = [(0, [], []), (1, [], []), (2, [0, 1], []), (3, [1], []), (4, [0], [0])]
    df = spark.createDataFrame([(chain,)], f"i {item}")
    assert df.select(first_fit(F.col("i"))).first()[0] == [0, 1, 0, 1, -1]
    assert spark.createDataFrame([([],)], f"i {item}").select(first_fit(F.col("i"))).first()[0] == []
    seeds = spark.createDataFrame([([(0, []), (1, [0]), (2, [1]), (3, [1, 2])],)], "i array<struct<place:int,same:array<int>>>")
    assert seeds.select(seed_labels(F.col("i"))).first()[0] == [0, 0, 2, 2]


def test_cache_keeps_answers_only():
    assert cache_fold([0, 5, 11, 12, 30], [10.0, 10.0, None, 3.0, 9.0]) == [False, True, False, False, False]


def test_review_groups(spark):
    rows = [(1, k, f"s{k}", "f", "set", f"v{k}", c, g, a) for k, (c, g, a) in enumerate([("missing", "g", None), ("missing", "g", None), ("key", None, None), ("format", None, None), ("format", "h", True), ("format", "h", None)])]
    df = spark.createDataFrame(rows, "citation_id int, ordinal int, id string, field string, kind string, suggested string, category string, grp string, accepted boolean")
    state = lambda d: [r["accepted"] for r in d.orderBy("ordinal").collect()]
    assert state(accept_all(df)) == [True, None, None, True, True, None]
    one = spark.createDataFrame([(1, "s5", True)], "citation_id int, id string, decision boolean")
    assert state(decide(df, one)) == [None, None, None, None, False, True]


BIB = """@article{k1, title="Deep learning for citation checks with gpt", author={Smith, J. and John Doe}, year=2019, journal={Journal of Data}, doi={https://doi.org/10.5555/1}, pages={1-10}}
@misc{k2, title={Something Else Entirely}, note={x}}"""


def works(spark, mapper, *payloads):
    return spark.createDataFrame([(json.dumps(p),) for p in payloads], "p string").select(mapper("p").alias("work"))


def sources(spark, failing=None):
    crossref = works(spark, map_crossref, {
        "DOI": "10.5555/1", "title": ["Deep Learning for Citation Checks with GPT"], "author": [{"family": "Smith", "given": "Jane"}, {"family": "Doe", "given": "John"}], "issued": {"date-parts": [[2020]]},
        "container-title": ["Journal of Data"], "type": "journal-article", "page": "1-10", "volume": "3",
    })
    dblp = works(spark, map_dblp, {"title": "Deep Learning for Citation Checks with GPT.", "authors": {"author": [{"text": "Jane Smith 0002"}, {"text": "John Doe"}]}, "year": "2020", "venue": "J. Data", "type": "Journal Articles", "key": "j/1"})
    made = lambda name, w, by=True: SnapshotSource(name, w.select(F.lower("work.doi").alias("doi_key"), F.lit("OK").alias("status"), "work"), with_norm_title(w), by, failing)
    none = crossref.filter("false")
    arxiv = spark.createDataFrame([], f"arxiv_id string, status string, work {WORK}")
    resolver = spark.createDataFrame([("10.5555/1", "OK", "http://x")], "doi_key string, status string, target string")
    return Sources(made("Crossref", crossref), made("DataCite", none), made("DBLP", dblp, False), made("OpenAlex", none), arxiv, resolver)


def test_whole_run(spark):
    run = analyze(spark.createDataFrame([("f", BIB)], "file_id string, text string"), sources(spark))
    chosen = {r["citation_id"]: r["selected"] for r in run.selection.collect()}
    assert chosen == {"f:0": 0, "f:1": None}
    s = {r["id"].split("-")[0] + ":" + r["category"]: r for r in suggestion_rows(run.evaluated).filter("citation_id = 'f:0'").collect()}
    assert s["year:conflict"]["value"] == "2020" and s["doi:format"]["value"] == "10.5555/1" and s["pages:format"]["value"] == "1--10" and s["title:format"]["value"].endswith("{GPT}")
    assert s["KEY:key"]["value"] == "smith_2020_deep_jdata" and all(r["accepted"] is None for r in s.values())
    fields = {r["field"]: r["status"] for r in comparison_rows(run.evaluated).filter("citation_id = 'f:0'").collect()}
    assert fields["title"] == "VERIFIED" and fields["year"] == "CONFLICT" and fields["doi"] == "VERIFIED"
    checks = {r["id"]: r["state"] for r in check_rows(run.evaluated).filter("citation_id = 'f:0'").collect()}
    assert checks == {"doi-syntax": "VERIFIED", "doi-resolve": "VERIFIED", "doi-meta": "VERIFIED", "doi-identity": "VERIFIED", "match": "VERIFIED"}


def test_unavailable_is_not_absent(spark):
    run = analyze(spark.createDataFrame([("f", BIB)], "file_id string, text string"), sources(spark, "RATE LIMITED"))
    assert run.candidates.count() == 0
    assert {r["status"] for r in run.statuses.filter("source <> 'DOI resolver'").collect()} == {"RATE LIMITED"}
    checks = {r["id"]: r["state"] for r in check_rows(run.evaluated).filter("citation_id = 'f:0'").collect()}
    assert checks["doi-meta"] == "NOT CHECKED" and checks["match"] == "UNVERIFIED"


def test_keys_by_stem(spark):
    """A stem's own keys decide on a free key as all keys of the file do; a file's other keys and other files' do not matter."""
    r = random.Random(5)
    suffix = lambda sep: r.choice(["", *(sep + c for c in "abcz"), sep, sep + "aa", "x"])
    for sep in ("_", "", "."):
        keys = {f: {r.choice(("doe2020", "doe2021", "x.y", "")) + suffix(sep) for _ in range(12)} for f in ("f", "g")}
        keys["f"] |= {f"full{sep}{chr(97 + i)}" for i in range(26)} | {"full"}
        rows = spark.createDataFrame([(f, k) for f, ks in keys.items() for k in ks] + [("f", None)], "file_id string, key string")
        found = {(x["file_id"], x["stem"]): x["existing_keys"] for x in keys_by_stem(rows, sep).collect()}
        assert max(map(len, found.values())) == 27
        for f, ks in keys.items():
            for base in ("doe2020", "doe2021", "x.y", "full", "new"):
                for own in sorted(ks):
                    assert free_key(base, set(found.get((f, base), ())) - {own}, sep) == free_key(base, ks - {own}, sep)
