"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Blocks of rows send each owner its share of their sorted, truncated hashes, Rice-coded (Golomb coding with a power of two).
Owners answer with a bitmap for each block: which of its hashes also came from elsewhere. Only rows that a bitmap or their
own block marks are suspects; their texts are shuffled and compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordcheck.llm.common import input_bytes, join_sized, materialize, table

#: Bits kept of a fingerprint in the exchange; two different texts share them once in 2^48, and bytes decide in the end.
HASH_BITS = 48
#: Rows of a block, at most, and input bytes that one owner answers for.
BLOCK_ROWS, OWNER_BYTES = 1 << 16, 8 << 20


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct unsigned integers -> (shift, code): unary quotients of the gaps, then fixed-width remainders."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = max(1, int(values[-1]) // len(values))
    shift = max(0, mean.bit_length() - 1)
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    stops = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 0
    bits = (gaps[:, None] >> np.arange(shift, dtype=np.uint64)) & np.uint64(1)
    return shift, np.packbits(unary).tobytes() + np.packbits(bits.astype(np.uint8)).tobytes()


def rice_decode(count: int, shift: int, code: bytes) -> np.ndarray:
    """The values that rice_encode was given."""
    if not count:
        return np.empty(0, np.uint64)
    tail = (count * shift + 7) // 8
    head = np.frombuffer(code, np.uint8, len(code) - tail)
    stops = np.flatnonzero(np.unpackbits(head) == 0)[:count]
    quotients = np.diff(stops, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(code, np.uint8, tail, len(code) - tail), count=count * shift).reshape(count, shift)
    rest = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(shift, dtype=np.uint64)) if shift else np.zeros(count, np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(shift)) + rest, dtype=np.uint64)


def _send(owners: int):
    """Hashes of a partition -> a coded list for each block and owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "owner", "n", "first", "shift", "code", "twice"]
        for b in batches:
            block, hashes = b.column("block").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            for which in np.unique(block):
                short = hashes[block == which] >> np.uint64(64 - HASH_BITS)
                values, counts = np.unique(short, return_counts=True)
                owner = (values * np.uint64(owners)) >> np.uint64(HASH_BITS) if owners < 1 << 16 else values % np.uint64(owners)
                rows = []
                for o in np.unique(owner):
                    at = owner == o
                    first = values[at][0]
                    shift, code = rice_encode(values[at] - first)
                    rows.append((int(which), int(o), int(at.sum()), int(first), shift, code, np.packbits(counts[at] > 1).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    return run


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """What one owner got -> for each block a bitmap of the hashes that are suspect, and those hashes."""
    lists = [rice_decode(n, s, c) + np.uint64(f) for n, f, s, c in zip(group["n"], group["first"], group["shift"], group["code"])]
    values, back, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    many = counts > 1
    edges = np.cumsum([0, *map(len, lists)])
    maps = [np.packbits(many[back[a:b]]).tobytes() for a, b in zip(edges, edges[1:])]
    return group.drop(columns="owner").assign(bitmap=maps)


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps, as the blocks get them back -> the hashes that they mark."""
    for b in batches:
        out = [np.empty(0, np.uint64)]
        for row in b.to_pylist():
            marks = np.unpackbits(np.frombuffer(row["bitmap"], np.uint8), count=row["n"]) | np.unpackbits(np.frombuffer(row["twice"], np.uint8), count=row["n"])
            values = rice_decode(row["n"], row["shift"], row["code"]) + np.uint64(row["first"])
            out.append(values[marks.astype(bool)])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)).view(np.int64))], names=["short"])


def suspect_hashes(keys: DataFrame, owners: int) -> DataFrame:
    """(block, fp) -> the truncated hashes that occur more than once, by the coded exchange."""
    coded = "n bigint, first bigint, shift bigint, code binary, twice binary"
    sent = keys.select("block", "fp").mapInArrow(_send(owners), f"block bigint, owner bigint, {coded}")
    answered = sent.groupBy("owner").applyInPandas(_answer, f"block bigint, {coded}, bitmap binary")
    return answered.repartition("block").mapInArrow(_suspects, "short bigint").distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs with keep_id, group_size, kept and text_sha256; texts are equal when their bytes are, null as empty.

    Of equal texts the row with the largest id stays; null ids rank lowest. Of rows alike in id and text, one stays: any, as
    they differ in nothing that is compared. keep_id is null only where all ids of a group are. Columns of docs are returned
    as they are, unless they have the names of the four new ones, which replace them. An empty table gives an empty one.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    own = [c for c in docs.columns if c not in added]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    short = F.shiftrightunsigned(F.xxhash64(text), 64 - HASH_BITS)
    block = F.xxhash64(F.spark_partition_id(), F.floor(F.monotonically_increasing_id() % (1 << 33) / BLOCK_ROWS))
    keys = docs.select(block.alias("block"), F.xxhash64(text).alias("fp"))
    owners = max(8, input_bytes(docs) // OWNER_BYTES)
    suspects = materialize(suspect_hashes(keys, owners), "exact-suspects")
    marked = docs.select(*own, F.sha2(text, 256).alias("text_sha256"), short.alias("__short"))
    single = join_sized(marked, suspects.withColumnRenamed("short", "__short"), "__short", "left_anti")
    single = single.select(*own, F.col(id_col).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    checked = join_sized(marked, suspects.withColumnRenamed("short", "__short"), "__short", "left_semi")
    checked = materialize(checked.withColumn("__row", F.monotonically_increasing_id()), "exact-checked")
    last = F.max(F.struct(F.coalesce(F.col(id_col).isNotNull(), F.lit(False)).alias("has"), F.col(id_col).alias("id"), F.col("__row").alias("row")))
    groups = checked.groupBy(F.col("text_sha256").alias("__sha"), text.alias("__text")).agg(last.alias("__last"), F.count("*").alias("group_size"))
    groups = materialize(groups, "exact-groups")  # stored, so that the join below shuffles both sides and can split hot groups
    joined = checked.join(groups.hint("merge"), (F.col("text_sha256") == F.col("__sha")) & (text == F.col("__text")))
    verified = joined.select(*own, F.col("__last.id").alias("keep_id"), "group_size", (F.col("__row") == F.col("__last.row")).alias("kept"), "text_sha256")
    return single.unionByName(verified)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
