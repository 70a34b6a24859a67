"""What the two exhaustive operators on vectors share: whole-number rows, blocks of queries met by blocks of rows, exact selection.

A stated set of queries meets all rows in cells: a cell holds the queries of one block and the rows of one block, both of bounded
size and dealt by a hash of the row's number, so that no id, label or repeated vector makes a cell larger than another.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordcheck.llm.common import materialize

#: Queries and rows of a cell, on average.
QUERY_BLOCK, ROW_BLOCK = 1024, 4096
LONG_MAX = (1 << 63) - 1


def numbered_vectors(vectors: DataFrame, label: str, id_col: str = "vec_id", vector_col: str = "embedding", **more) -> DataFrame:
    """(row, id, vector, more): a stored copy of the rows that take part, each with a number of its own.

    Rows whose id or vector is null, or whose vector holds a null, NaN or infinite component, take no part. more: further
    columns by name; rows in which one of them is null take no part either. Repeated rows keep numbers of their own.
    """
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double") * 256.0) < float("inf"), F.lit(False)))
    kept = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    kept = kept.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"), *[c.alias(n) for n, c in more.items()])
    return materialize(kept.dropna(subset=list(more) or ["id"]).select(F.monotonically_increasing_id().alias("row"), "*"), label)


def in_cells(queries: DataFrame, rows: DataFrame, task: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """task(queries of a block, rows of a block) for each pair of blocks; every query meets every row in exactly one cell."""
    heights, widths = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-rows.count() // ROW_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = queries.withColumn("height", block(heights)).withColumn("width", each(widths))
    right = rows.withColumn("width", block(widths)).withColumn("height", each(heights))
    return left.groupBy("height", "width").cogroup(right.groupBy("height", "width")).applyInArrow(task, schema)


def whole_numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors -> a matrix of floor(256 * x) as doubles; shorter vectors are filled up with zeros."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256.0)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """int64 where no inner product of rows of a and b can leave it, else object (whole numbers of Python)."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, min(a.shape[1], b.shape[1]))
    return np.int64 if bound <= LONG_MAX else object


def as_kind(values: np.ndarray, kind: type) -> np.ndarray:
    if kind is np.int64:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], dtype=object).reshape(values.shape)


def to_long(scores) -> np.ndarray:
    """Scores as longs; what is beyond their range counts as its end."""
    found = np.asarray(scores)
    return found if found.dtype == np.int64 else np.array([max(-LONG_MAX - 1, min(LONG_MAX, int(x))) for x in found.tolist()], np.int64)


def highest(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the positions `at` (ascending) the k with the highest scores, ties in order of position; fewer if there are no more."""
    if len(at) > k:
        found = scores[at]
        least = np.partition(found, len(at) - k)[len(at) - k]
        at = at[found >= least]
    return at[np.argsort(-scores[at], kind="stable")][:k]


def by_id(table: pa.Table) -> pa.Table:
    """Rows in the order in which ties are broken."""
    return table.sort_by([("id", "ascending"), ("row", "ascending")])
