"""What must not grow with the input in one place: broadcasts, tasks that read everything, lists that are compared pairwise."""

import random

from oracle import SF
from pyspark.sql import functions as F

from recordcheck.operators.apply import apply_suggestions
from recordcheck.operators.candidates import first_fit, first_fit_rows, select_candidate
from recordcheck.plans.queries import QUERIES
from recordcheck.sources.bibtex import items
from recordcheck.storage import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_are_not_broadcast(spark):
    rows = stored(spark.range(50).selectExpr("id", "'a' AS text"), "test")
    joined = rows.join(spark.range(9), "id").groupBy("id").count().join(rows, "id")
    assert "Broadcast" not in plan(joined) and joined.count() == 9


def test_entries_are_not_broadcast(spark):
    assert "Broadcast" not in plan(QUERIES["bibtex_field_rows"](spark, SF))
    entries = spark.createDataFrame([(1, "@misc{k, a = {b}}")], "citation_id long, text string")
    change = spark.createDataFrame([(1, 0, "s0", "a", "set", "c", None, None, True)], "citation_id long, ordinal int, id string, field string, kind string, value string, term string, to string, accepted boolean")
    done = apply_suggestions(entries, change)
    assert "Broadcast" not in plan(done) and done.first()["result"] == "@misc{k, a = {c}}"
    score = "score struct<total:double,identifier_match:boolean,state:string>, version_group int"
    none = spark.createDataFrame([], f"citation_id long, place int, work struct<is_preprint:boolean>, {score}")
    chosen = select_candidate(spark.read.parquet(f"{SF}/part.parquet").select(F.col("p_partkey").alias("citation_id")), none)
    assert "Broadcast" not in plan(chosen)


def test_texts_are_dealt_over_tasks(spark):
    parsed = items(spark.range(60).selectExpr("id", "concat('@misc{k', id, '}@misc{b}') AS text").coalesce(1), "id")
    assert "hashpartitioning(file_id" in plan(parsed)
    assert parsed.groupBy("file_id").count().filter("count = 2").count() == 60


def test_first_fit_of_rows_as_of_arrays(spark):
    r = random.Random(4)
    rows, lists = [], []
    for citation in range(30):
        kinds = r.randint(1, 8)
        alike = {a: [b for b in range(kinds) if r.random() < 0.4] for a in range(kinds)}
        twins = [r.randint(0, 2) for _ in range(kinds)]
        listed, first = [], {}
        for place in range(r.randint(1, 40)):
            kind = r.randrange(kinds)
            fresh = kind not in first
            first.setdefault(kind, place)
            earlier = [(p, k) for p, k in enumerate(x[0] for x in listed)]
            listed.append((kind, [p for p, k in earlier if k in alike[kind]], [p for p, k in earlier if twins[k] == twins[kind]]))
            rows.append((citation, place, kind, twins[kind], alike[kind] if fresh else None))
        lists.append((citation, [(place, same, twin) for place, (_, same, twin) in enumerate(listed)]))
    got = first_fit_rows(spark.createDataFrame(rows, "citation_id long, place int, class int, twin int, matches array<int>"))
    arrays = spark.createDataFrame(lists, "citation_id long, i array<struct<place:int,same:array<int>,twin:array<int>>>")
    want = arrays.select("citation_id", F.posexplode(first_fit("i")).alias("place", "group"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
