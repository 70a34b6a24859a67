"""Stored answers of services: what a filter pushes, and lookups by filter and by join."""

import tempfile

from pyspark.sql import functions as F

from recordcheck.sources.answers import AnswersLookup, bucket_of, read_answers, write_answers


def test_pushed_filters_and_lookups(spark):
    folder = f"file://{tempfile.mkdtemp(prefix='answers-')}/x"
    body = lambda k: '{"DOI": "10.5555/%s", "title": ["T%s"]}' % (k, k)
    rows = [("Crossref", f"10.5555/{k}", 200 if k % 5 else 503, body(k)) for k in range(200)] + [("DataCite", "10.5555/7", 200, "{}"), ("Crossref", None, 200, "{}"), ("Crossref", "10.5555/x", 200, None)]
    write_answers(spark.createDataFrame(rows, "source string, key string, http int, body string"), folder, 16)
    every = read_answers(spark, folder, 16)
    assert every.count() == 202 and every.rdd.getNumPartitions() == 16
    keys = ["10.5555/7", "10.5555/8"]
    few = every.filter(F.col("key").isin(keys) & (F.col("source") == "Crossref") & F.col("body").contains("T"))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert few.rdd.getNumPartitions() == len({bucket_of(k, 16) for k in keys})
    # key and source are filtered by the source alone, the other condition by Spark
    assert "Contains(body" in plan and "key#" not in plan.partition("Filter")[2].partition("\n")[0], plan
    assert sorted((r["source"], r["key"]) for r in few.collect()) == [("Crossref", k) for k in keys]
    assert every.filter("key = '10.5555/7' AND key = '10.5555/9'").count() == 0 and every.filter("key = 'none'").count() == 0 and every.filter("key IS NULL").count() == 0
    wanted = spark.createDataFrame([(1, "10.5555/7"), (2, "10.5555/10"), (3, "none"), (4, None), (5, "10.5555/7"), (6, "10.5555/x")], "citation_id long, doi_key string")
    for pushed in (100, 1):
        found = {r["citation_id"]: (r["status"], r["work"] and r["work"]["title"]) for r in AnswersLookup(spark, "Crossref", folder, buckets=16, pushed=pushed).lookup(wanted).collect()}
        assert found == {1: ("OK", "T7"), 2: ("LOOKUP FAILED", None), 3: ("NO RECORD FOUND", None), 5: ("OK", "T7"), 6: ("LOOKUP FAILED", None)}
    assert AnswersLookup(spark, "Crossref", folder, buckets=16).lookup(wanted.limit(0)).count() == 0
