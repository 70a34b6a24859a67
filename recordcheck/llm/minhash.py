"""MinHash fingerprints of documents, and near-duplicate classes from signature bands with verified Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordcheck.llm.common import input_bytes, materialize, table
from recordcheck.llm.components import connected_components
from recordcheck.llm.simhash import shingle_hashes

#: Hash permutations, words of a shingle, least similarity; bands times rows of the signature make a candidate key.
PERMUTATIONS, WORDS, SIMILARITY = 128, 5, 0.8
BANDS, ROWS = 25, 5
EMPTY_ID = -(1 << 63)
#: Input bytes of a run of neighbouring ids that one task reads in order.
RUN_BYTES = 8 << 20


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of universal hashes a * x + b modulo 2^64."""
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, count, dtype=np.uint64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sixteen bits of the least value of each permutation over the hashes; all ones where there are none."""
    low = np.full(len(a), 0xFFFFFFFFFFFFFFFF, np.uint64)
    if not len(hashes):
        return np.full(len(a), 0xFFFF, np.uint16)
    for k in range(0, len(hashes), 512):
        np.minimum(low, (a[:, None] * hashes[None, k : k + 512] + b[:, None]).min(axis=1), out=low)
    for s in (32, 16):
        low = low ^ (low >> np.uint64(s))
    return low.astype(np.uint16)


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored runs of rows in descending id order, each run ending with a copy of the next run's first row.

    Returns (part, copy, id, text) dealt by part and sorted; after the smallest id comes the largest. Null ids count as the
    smallest; rows of one id are ordered by text. Only a bound and a first id for each run reach the driver.
    """
    rows = docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(EMPTY_ID)).alias("key"), docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // RUN_BYTES)
    at = F.percentile_approx("key", [k / parts for k in range(1, parts)], 20 * parts)
    bounds = np.unique(np.array(rows.agg(at.alias("b")).first()["b"] or [], np.int64))

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, key.to_numpy(), side="right")).astype("int32")

    heads = {r["part"]: r["head"] for r in rows.select("key", part_of("key").alias("part")).groupBy("part").agg(F.max("key").alias("head")).collect()}
    order = sorted(heads)
    before = {p: order[k - 1] for k, p in enumerate(order)}  # of the first run, the last

    @F.pandas_udf("array<int>")
    def targets(key: pd.Series) -> pd.Series:
        found = len(bounds) - np.searchsorted(bounds, key.to_numpy(), side="right")
        return pd.Series([[p, before[p]] if heads[p] == k else [p] for p, k in zip(found.tolist(), key.tolist())])

    dealt = rows.select("key", "id", "text", F.posexplode(targets("key")).alias("copy", "part"))
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "copy", F.desc("key"), "text").select("part", "copy", "id", "text")


def _fingerprints(count: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(count)
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        mark = lambda s: s.astype(">u2").tobytes().hex()
        sign = lambda t: signature(shingle_hashes(t, words), a, b)
        waiting = None  # (part, id, text, signature) until the next row is known
        done = None  # the part whose last row has met the copy of its follower

        def finish(row, text, sig):
            new = edited(row[2], text)
            other = sign(new)
            sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            return row[1], len(row[2]), sha, mark(row[3]), mark(other), float((row[3] == other).mean()), float((row[3] == sig).mean())

        for batch in batches:
            out = []
            kind = batch.schema.field(2).type
            for part, copy, id_, text in zip(*(c.to_pylist() for c in batch.columns)):
                if copy and part == done:
                    continue
                sig = sign(text)
                if waiting is not None:
                    out.append(finish(waiting, text, sig))
                waiting = None if copy else (part, id_, text, sig)
                done = part if copy else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) if k == 0 else pa.array(c) for k, c in enumerate(zip(*out))], names=names)

    return run


def fingerprints(docs: DataFrame, count: int = PERMUTATIONS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness, a row for each row of docs.

    Null texts count as empty. Texts without words share one fingerprint; of up to `words` words, the whole is one shingle.
    Likeness is the share of equal permutations. Repeated rows follow one another; a single row is followed by itself.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(_fingerprints(count, words), schema).withColumnRenamed("id", id_col)


def _signed(count: int, words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(count)
        for batch in batches:
            shingles, keys = [], []
            for text in batch.column(1).to_pylist():
                hashes = np.unique(shingle_hashes(text, words))
                sig = signature(hashes, a, b)
                shingles.append(hashes.view(np.int64))
                keys.append([int.from_bytes(hashlib.blake2b(bytes([k]) + sig[k * rows : (k + 1) * rows].tobytes(), digest_size=8).digest(), "little", signed=True) for k in range(bands)])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shingles, kind), pa.array(keys, kind)], names=["node", "shingles", "bands"])

    return run


def _verified(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) whose shingle sets have at least the Jaccard similarity."""
    left = signed.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
    right = signed.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "u").join(right, "v").filter(both >= similarity * (F.size("x") + F.size("y") - both)).select("u", "v")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id) for every row: the smallest id that verified links between candidates reach.

    Equal shingle sets make one node. First, every node of a band's bucket is verified against the bucket's smallest node;
    then only pairs of one bucket that are not connected yet are. So no link between candidates is lost, and a large group
    of near copies costs a star for each band. Texts without words form one class; null ids are passed over.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = materialize(docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("node")), "minhash-rows")
    texts = docs.select(F.xxhash64(text).alias("node"), text.alias("text")).dropDuplicates(["node"])
    signed = materialize(texts.mapInArrow(_signed(PERMUTATIONS, WORDS, BANDS, ROWS), "node bigint, shingles array<bigint>, bands array<bigint>"), "minhash-signed")
    bands = materialize(signed.select("node", F.explode("bands").alias("key")), "minhash-bands")
    least = bands.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("n")).filter("n > 1").select("key", "v")
    stars = bands.join(least, "key").select(F.col("node").alias("u"), "v").filter("u <> v").distinct()
    links = materialize(_verified(stars, signed, similarity), "minhash-links")
    roots = connected_components(links, "minhash-components")
    placed = bands.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    placed = materialize(placed.join(mixed, "key"), "minhash-placed")
    rest = placed.select("key", F.col("node").alias("u"), F.col("root").alias("r")).join(placed.select("key", F.col("node").alias("v"), F.col("root").alias("s")), "key")
    late = _verified(rest.filter("r <> s AND u > v").select("u", "v").distinct(), signed, similarity)
    roots = connected_components(links.unionByName(late), "minhash-components")
    named = rows.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "minhash-named")
    return named.join(named.groupBy("root").agg(F.min("id").alias("class_id")), "root").select(F.col("id").alias(id_col), "class_id")


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
