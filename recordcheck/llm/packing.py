"""Packing of token streams by concatenating and cutting.

Pass one tokenizes each document once and stores its ids with their offset in their part (a partition of the input). The
parts' token totals, a row each, give every part its global offset by a prefix sum. Pass two cuts the stream into windows of
a fixed length; a document that crosses a window's end gives a boundary record on either side.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordcheck.llm.common import join_sized, materialize, table

#: Tokens of a sequence, and the id that ends a document.
SEQUENCE, END = 2048, 1


def encoder(path: str):
    """Texts -> lists of ids of a byte-level BPE vocabulary, as `tokenizers` gives them with add_special_tokens=False.

    A rank file of the same name, where there is one, gives the same ids several times faster than the vocabulary's JSON. It
    knows nothing of added tokens (`<|endoftext|>`), so texts that hold one go through the JSON.
    """
    from tokenizers import Tokenizer

    ranked = path.removesuffix(".json") + ".tiktoken"
    if not (path.endswith(".json") and os.path.exists(ranked)):
        full = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in full.encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    with open(ranked, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        added = [re.escape(t["content"]) for t in json.load(f).get("added_tokens", ())]
    holds = re.compile("|".join(added) or r"(?!)").search
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = None

    def encode(texts: list[str]) -> list[list[int]]:
        nonlocal full
        found = [None if holds(t) else coder.encode_ordinary(t) for t in texts]
        if None in found:
            full = full or Tokenizer.from_file(path)
            found = [full.encode(t, add_special_tokens=False).ids if f is None else f for t, f in zip(texts, found)]
        return found

    return encode


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        start = 0
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = [np.array([*x, end], "<u4") for x in encode([t or "" for t in part.column(1).to_pylist()])]
                sizes = np.array([len(x) for x in ids], np.int64)
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                narrow = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else x.tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(starts), pa.array(sizes), pa.array(narrow, pa.binary())], names=["id", "part", "start", "size", "ids"])

    return run


def _cut(window: int):
    """Stored documents with their global offsets -> pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, pieces = [], []
            for k, (at, size, raw) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * size else "<u4").astype("<u4").tobytes()
                start = 0
                while start < size:
                    length = min(size - start, window - (at + start) % window)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append(k)
                    pieces.append((start, length, crc, size, (at + start) // window, (at + start) % window))
                    start += length
            columns = np.array(pieces, np.int64).reshape(-1, 6).T
            ids_ = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_, *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=["id", *NAMES])

    return run


NAMES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def stored_tokens(docs: DataFrame, tokenizer: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """Stored (id, part, start, size, ids): each document's ids, little-endian, of two bytes each where all are below 2^16."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), F.spark_partition_id().cast("bigint").alias("part"))
    return materialize(rows.mapInArrow(_tokenize(tokenizer, end), f"id {kind}, part bigint, start bigint, size bigint, ids binary"), "packing-tokens")


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = SEQUENCE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents -> pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    All sequences but the last are full. Null and empty texts give a document of the end id alone; repeated rows and null
    ids are packed like any other. Rows are neither joined nor sorted: a part's offset is looked up among one row a part.
    """
    tokens = stored_tokens(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end, id_col, text_col)
    totals = tokens.groupBy("part").agg(F.sum("size").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = join_sized(tokens, materialize(offsets, "packing-offsets"), ["part"])  # as many rows as the input had partitions
    kind = docs.schema[id_col].dataType.simpleString()
    rows = placed.select("id", (F.col("base") + F.col("start")).alias("at"), "size", "ids")
    schema = f"id {kind}, " + ", ".join(f"`{c}` bigint" for c in NAMES)
    return rows.mapInArrow(_cut(window), schema).withColumnRenamed("id", id_col)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
