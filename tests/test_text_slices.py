"""Whole documents: a batch is made of Python strings slice by slice, so a worker's memory is a small multiple of a batch."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from recordcheck.functions.arrow import SLICE, in_slices
from recordcheck.functions.text import normalize_text, normalized, normalized_document


def test_slices_hold_a_part_of_a_batch():
    texts = pa.array([f"{k} " + "x" * 20_000 for k in range(20 * SLICE)])
    tracemalloc.start()
    got = in_slices(str.upper, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [t.upper() for t in texts.to_pylist()] and peak < texts.nbytes / 4


def test_of_slices_as_of_batches(spark):
    some = ["{D}eep \\'Etude--of $x$", "", None, "Straße ﬁ", "a\u0301b"]
    rows = spark.createDataFrame([(k, some[k % 5] if k % 7 else f"own {k}") for k in range(3 * SLICE + 1)], "k int, text string").coalesce(1)
    both = rows.select(normalized("text").alias("a"), normalized_document(F.col("text")).alias("b"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0 and both.count() == 3 * SLICE + 1
    assert in_slices(normalize_text, pa.array([], pa.string())).to_pylist() == []
