"""Hard-negative mining by a secondary-sort shuffle.

Scores of (anchor, row) pairs are packed into keys that sort by anchor, descending score and id. `repartitionAndSortWithinPartitions`
deals them by anchor, and one pass over a partition reads each anchor's pairs from the highest score down: a row of the same
label opens a window, a row of another label is emitted for each open window that its score lies in. At most five windows are
held at a time, however many pairs an anchor has.

Pairs are scored in cells (see `vectors`) and thinned there without loss: a first run takes each cell's best rows of the
anchor's label, whose merge gives the anchor's positives; a second run knows the windows and keeps, for each, the cell's best
rows of other labels within it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordcheck.llm.common import materialize, table
from recordcheck.llm.vectors import LONG_MAX, as_kind, by_id, exact_kind, highest, in_cells, numbered_vectors, to_long, whole_numbers

#: Anchors whose scores are held at a time.
SCORED = 128
PAIRS = "anchor bigint, row bigint, id bigint, score bigint"
#: anchor's row, distance of the score from the largest long, whether the label differs, id and row with the sign bit turned.
KEY = ">QQBQQ"
SIGN = 1 << 63


def pack_key(anchor: int, score: int, differs: bool, id_: int, row: int) -> bytes:
    """A pair as bytes that sort by anchor, then descending score, then rows of the anchor's label first, then id, then row."""
    return struct.pack(KEY, anchor, LONG_MAX - score, differs, id_ + SIGN, row)


def unpack_key(key: bytes) -> tuple[int, int, bool, int]:
    anchor, down, differs, id_, _ = struct.unpack(KEY, key)
    return anchor, LONG_MAX - down, bool(differs), id_ - SIGN


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def _scores(asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles where these hold every sum, else by whole numbers."""
    width = min(asked.shape[1], held.shape[1])
    asked, held = asked[:, :width], held[:, :width]
    if float(np.abs(asked).max(initial=0)) * float(np.abs(held).max(initial=0)) * max(1, width) < 2.0**53:
        return (asked @ held.T).astype(np.int64)
    kind = exact_kind(asked, held)
    found = as_kind(asked, kind) @ as_kind(held, kind).T
    return found if kind is np.int64 else to_long(found.ravel()).reshape(found.shape)


def _cell(choose):
    """choose(scores of one anchor, positions of the rows of its label, of other labels, the anchor's windows) -> positions."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = by_id(rows)
        asked, held = whole_numbers(anchors.column("vector")), whole_numbers(rows.column("vector"))
        ids, numbers, labels = (rows.column(c).to_numpy() for c in ("id", "row", "kind"))
        own, mine = anchors.column("row").to_numpy(), anchors.column("kind").to_numpy()
        windows = anchors.column("positives").to_pylist() if "positives" in anchors.column_names else [None] * len(own)
        out = []
        for start in range(0, len(own), SCORED):
            for i, scores in enumerate(_scores(asked[start : start + SCORED], held), start):
                same = labels == mine[i]
                best = choose(scores, np.flatnonzero(same & (numbers != own[i])), np.flatnonzero(~same), windows[i])
                out.append((np.full(len(best), own[i]), numbers[best], ids[best], scores[best]))
        columns = [np.concatenate(c) for c in zip(*out)] or [np.empty(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["anchor", "row", "id", "score"])

    return run


def _inside(negatives: int, low: int, high: int):
    def choose(scores: np.ndarray, _same: np.ndarray, other: np.ndarray, positives: list[int]) -> np.ndarray:
        found, theirs = [np.empty(0, np.int64)], scores[other]
        for p in set(positives):
            least, most = window(p, low, high)
            if least <= most:
                found.append(highest(scores, other[(theirs >= max(least, -LONG_MAX)) & (theirs <= most)], negatives))
        return np.unique(np.concatenate(found))

    return choose


def _mine(negatives: int, low: int, high: int):
    """Sorted (key, nothing) pairs of a partition -> its negatives; holds the open windows of one anchor."""

    def run(pairs: Iterator[tuple[bytes, None]]) -> Iterator[tuple[int, int, int, int, int, int]]:
        now, opened = None, []
        for key, _ in pairs:
            anchor, score, differs, id_ = unpack_key(key)
            if anchor != now:
                now, opened = anchor, []
            if not differs:
                opened.append([id_, score, 0, *window(score, low, high)])
                continue
            for w in opened:
                if w[2] < negatives and w[3] <= score <= w[4]:
                    w[2] += 1
                    yield anchor, w[0], w[2], id_, w[1], score

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): up to `negatives` for each anchor and positive.

    A row's score is its exact whole-number inner product with the anchor, components as floor(256 * x); what is beyond a long's
    range counts as its end. Higher scores come first, ties by smaller id. An anchor's positives are its first `positives` other
    rows of its label; a positive's negatives are the first rows of other labels whose score lies within low to high hundredths
    of the positive's. A positive with a score below zero has no such rows, one of zero has those of score zero.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths are
    filled up with zeros. Rows are what is compared: repeats of an anchor are positives of it and anchors of their own. Other
    columns are not read. Empty tables, anchors without positives and positives without negatives give no rows.
    """
    kept = numbered_vectors(vectors, "negatives-vectors", id_col, vector_col, kind=label.cast("bigint"), asks=F.coalesce(is_anchor, F.lit(False)))
    anchors, rows = kept.filter("asks").select("row", "vector", "kind"), kept.select("row", "id", "vector", "kind")
    alike = in_cells(anchors, rows, _cell(lambda s, same, _other, _w: highest(s, same, positives)), PAIRS)
    ranked = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    first = materialize(alike.withColumn("__rank", F.row_number().over(ranked)).filter(F.col("__rank") <= positives).drop("__rank"), "negatives-positives")
    opened = first.groupBy("anchor").agg(F.collect_list("score").alias("positives")).withColumnRenamed("anchor", "row")  # `positives` of each at most
    inside = in_cells(materialize(anchors.join(opened, "row"), "negatives-anchors"), rows, _cell(_inside(negatives, low, high)), PAIRS)
    pairs = materialize(first.withColumn("differs", F.lit(False)).unionByName(inside.withColumn("differs", F.lit(True))), "negatives-pairs")
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = pairs.rdd.map(lambda p: (pack_key(p["anchor"], p["score"], p["differs"], p["id"], p["row"]), None))
    sorted_ = keyed.repartitionAndSortWithinPartitions(tasks, lambda key: zlib.crc32(key[:8]))
    mined = sorted_.mapPartitions(_mine(negatives, low, high))
    found = vectors.sparkSession.createDataFrame(mined, "anchor bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    names = kept.filter("asks").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


OP11_SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM kept a JOIN kept c ON c.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0
),
positives AS (
  SELECT anchor_id, id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
