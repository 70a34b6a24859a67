"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of (component, weight) terms. In a cell (see `vectors`), the rows of a block are turned into postings,
one list of rows and weights for each component; every term of a query scatters its weighted postings into a dense array of
scores, one for each row of the block. A partition selection takes the block's best; blocks' best are merged by a ranked window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordcheck.llm.common import materialize, table
from recordcheck.llm.vectors import as_kind, by_id, exact_kind, highest, in_cells, numbered_vectors, to_long, whole_numbers


def postings(rows: np.ndarray) -> list[tuple[slice | np.ndarray, np.ndarray]]:
    """A matrix of weights -> for each component the rows that have it and their weights; a list of all rows needs no numbers."""
    found = []
    for weights in rows.T:
        at = np.flatnonzero(weights)
        found.append((slice(None), weights.copy()) if len(at) == len(weights) else (at, weights[at]))
    return found


def accumulate(query: np.ndarray, lists: list, scores: np.ndarray) -> np.ndarray:
    """Scatter a query's terms, one at a time, into the dense array `scores`, which is cleared before."""
    scores[:] = 0
    for term in np.flatnonzero(query[: len(lists)]):
        at, weights = lists[term]
        scores[at] += query[term] * weights
    return scores


def _search(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = by_id(rows)
        asked, held = whole_numbers(queries.column("vector")), whole_numbers(rows.column("vector"))
        kind = exact_kind(asked, held)
        lists, scores = postings(as_kind(held, kind)), np.zeros(len(held), kind)
        ids, numbers = rows.column("id").to_numpy(), rows.column("row").to_numpy()
        out = []
        for number, query in zip(queries.column("row").to_numpy(), as_kind(asked, kind)):
            best = highest(accumulate(query, lists, scores), np.flatnonzero(numbers != number), k)
            out.append((np.full(len(best), number), ids[best], numbers[best], to_long(scores[best])))
        columns = [np.concatenate(c) for c in zip(*out)] or [np.empty(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_row", "vec_id", "vec_row", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k other rows of highest inner product, all if there are fewer.

    Components count as floor(256 * x); products are exact whole numbers, and beyond a long's range its end is returned. Ties
    go to the smaller id. is_query: a condition on the given columns (null: no query). Rows whose id or vector is null or holds
    null or non-finite components take no part; of vectors of different lengths the shorter is filled up with zeros. Rows are
    what is compared: a repeat of a query row is a candidate, and a query of its own. Other columns are not read. An empty
    table, or one without queries, gives no rows.
    """
    kept = numbered_vectors(vectors, "topk-vectors", id_col, vector_col, asks=F.coalesce(is_query, F.lit(False)))
    queries = kept.filter("asks").select("row", "vector")
    found = in_cells(queries, kept.select("row", "id", "vector"), _search(k), "query_row bigint, vec_id bigint, vec_row bigint, score bigint")
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    best = materialize(found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k), "topk-best")
    names = kept.filter("asks").select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return best.join(names, "query_row").select("query_id", "rank", "vec_id", "score")


def op13_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM kept q JOIN kept c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
