"""Stupid-backoff language-model scores from n-gram counts over the whole corpus.

Rows are dealt into blocks by a hash. A block sends each owner (a range of n-gram hashes) its distinct n-grams and their
counts, Rice-coded; owners add up the count tables, join them to what each block asked for, and answer with corpus counts.
A block explodes its texts into n-grams again, looks the counts up by rank, and sums the scores for each document.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordcheck.llm.common import input_bytes, table
from recordcheck.llm.exact import rice_decode, rice_encode

#: Order of the model, factor of each back-off, and count from which an n-gram of two or more words counts as seen: one
#: that occurs once was seen in the scored document alone.
ORDER, BACKOFF, LEAST = 3, 0.4, 2
#: Bits of an n-gram's hash; at a billion n-grams one in 280,000 shares another's.
HASH_BITS = 48
#: Input bytes of a block and of an owner.
BLOCK_BYTES, OWNER_BYTES = 6 << 20, 3 << 20
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def block_ngrams(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(distinct hashes, their counts, for each order the index of the n-gram that ends at each token or -1, tokens a text).

    Words are runs of other than ASCII white space, with A-Z in lower case. Hash 0 stands for the empty n-gram, whose count
    is the number of tokens.
    """
    split = [(t or "").encode("utf-8", "surrogatepass").translate(UPPER).split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    codes, words = pd.factorize(np.array(list(chain.from_iterable(split)), dtype=object))
    hashed = np.array([xxhash.xxh64_intdigest(w, 7) for w in words], np.uint64)
    one = hashed[codes] if len(codes) else np.empty(0, np.uint64)
    place = np.arange(len(one)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams, valid = [one], [np.ones(len(one), bool)]
    for n in range(1, order):
        longer = np.zeros_like(one)
        longer[n:] = _mix(grams[-1][:-1][n - 1 :] * np.uint64(0x9E3779B97F4A7C15) + one[n:] + np.uint64(n)) if len(one) > n else longer[n:]
        grams.append(longer)
        valid.append(place >= n)
    flat = np.concatenate([(g[v] >> np.uint64(64 - HASH_BITS)) | np.uint64(1) for g, v in zip(grams, valid)])
    values, back, counts = np.unique(flat, return_inverse=True, return_counts=True)
    index, at = [], 0
    for v in valid:
        k = np.full(len(one), -1, np.int64)
        n = int(v.sum())
        k[v] = back[at : at + n] + 1
        at += n
        index.append(k)
    return np.r_[np.uint64(0), values], np.r_[len(one), counts], index, sizes


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte for each count under 255; larger ones follow in eight."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def unpack_counts(n: int, code: bytes) -> np.ndarray:
    out = np.frombuffer(code, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(code, "<i8", offset=n)
    return out


def _owner(values: np.ndarray, owners: int) -> np.ndarray:
    return ((values * np.uint64(owners)) >> np.uint64(HASH_BITS)).astype(np.int64)


def _send(order: int, owners: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        values, counts, _, _ = block_ngrams(block["text"].tolist(), order)
        edges = np.searchsorted(_owner(values, owners), np.arange(owners + 1))
        rows = []
        for o in np.flatnonzero(np.diff(edges)):
            a, b = edges[o], edges[o + 1]
            shift, code = rice_encode(values[a:b] - values[a])
            rows.append((int(o), int(block["block"].iloc[0]), int(b - a), int(values[a]), shift, code, pack_counts(counts[a:b])))
        return pd.DataFrame(rows, columns=["owner", "block", "n", "first", "shift", "code", "counts"])

    return run


def _answer(got: pd.DataFrame) -> pd.DataFrame:
    lists = [rice_decode(n, s, c) + np.uint64(f) for n, f, s, c in zip(got["n"], got["first"], got["shift"], got["code"])]
    _, back = np.unique(np.concatenate(lists), return_inverse=True)
    sums = np.bincount(back, np.concatenate([unpack_counts(n, c) for n, c in zip(got["n"], got["counts"])]).astype(float)).astype(np.int64)
    edges = np.cumsum([0, *map(len, lists)])
    found = [pack_counts(sums[back[a:b]]) for a, b in zip(edges, edges[1:])]
    return pd.DataFrame({"block": got["block"], "owner": got["owner"], "n": got["n"], "counts": found})


def backoff_scores(counts: np.ndarray, index: list[np.ndarray], least: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """For each token the natural logarithm of its stupid-backoff score, and the order that it was found at."""
    total = counts[0]
    with np.errstate(divide="ignore"):
        logs = np.log(np.maximum(counts, 1))
    score = logs[index[0]] - np.log(max(1, total))
    level = np.ones(len(score), np.int64)
    for n in range(1, len(index)):
        here = index[n]
        seen = (here >= 0) & (counts[here] >= least)
        before = np.r_[np.int64(-1), index[n - 1][:-1]]  # the context ends at the token before
        score = np.where(seen, logs[here] - logs[before], np.where(here >= 0, score + np.log(backoff), score))
        level[seen] = n + 1
    return score, level


def _score(order: int, least: int, backoff: float):
    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({"id": [], "n_tokens": [], "log_score": [], "longest": []})
        values, _, index, sizes = block_ngrams(block["text"].tolist(), order)
        answers = answers.sort_values("owner")
        counts = np.concatenate([unpack_counts(n, c) for n, c in zip(answers["n"], answers["counts"])])
        assert len(counts) == len(values), "an owner's answer is missing"
        score, level = backoff_scores(counts, index, least, backoff)
        row = np.repeat(np.arange(len(sizes)), sizes)
        return pd.DataFrame({"id": block["id"], "n_tokens": sizes, "log_score": np.bincount(row, score, len(sizes)), "longest": np.bincount(row, level == order, len(sizes)).astype(np.int64)})

    return run


def score_documents(docs: DataFrame, order: int = ORDER, least: int = LEAST, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_score, longest): the summed log score of each row's text under counts over all rows' texts, and the
    tokens that were found at the highest order.

    The first tokens of a text have shorter contexts only and pay no factor for that. Null and empty texts have no tokens
    and score 0; repeated rows count and score each. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    size, tasks = input_bytes(docs), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, owners = max(2 * tasks, size // BLOCK_BYTES), min(1 << 16, max(2 * tasks, size // OWNER_BYTES)) - 1
    text = docs[text_col].cast("string")
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = docs.select(docs[id_col].alias("id"), text.alias("text"), F.pmod(F.xxhash64(docs[id_col], text), F.lit(blocks)).alias("block")).groupBy("block")
    sent = dealt.applyInPandas(_send(order, owners), "owner bigint, block bigint, n bigint, first bigint, shift bigint, code binary, counts binary")
    answers = sent.groupBy("owner").applyInPandas(_answer, "block bigint, owner bigint, n bigint, counts binary")
    scored = dealt.cogroup(answers.groupBy("block")).applyInPandas(_score(order, least, backoff), f"id {kind}, n_tokens bigint, log_score double, longest bigint")
    return scored.withColumnRenamed("id", id_col)


def op4_backoff(spark, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    mean = F.col("log_score") / F.greatest("n_tokens", F.lit(1))
    return scored.select("doc_id", "n_tokens", F.round(mean, 5).alias("mean_log_score"), "longest")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x09-\\x0D\\x20]+') AS words
  FROM documents
),
w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM d),
g AS (SELECT r, w, lag(w, 1) OVER q AS w1, lag(w, 2) OVER q AS w2 FROM w WINDOW q AS (PARTITION BY r ORDER BY p)),
c1 AS (SELECT w, count(*) AS n FROM g GROUP BY w),
c2 AS (SELECT w1, w, count(*) AS n FROM g WHERE w1 IS NOT NULL GROUP BY w1, w),
c3 AS (SELECT w2, w1, w, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY w2, w1, w),
s AS (
  SELECT g.r, CASE
      WHEN g.w2 IS NOT NULL AND c3.n >= 2 THEN ln(c3.n) - ln(h2.n)
      WHEN g.w2 IS NOT NULL AND c2.n >= 2 THEN ln(0.4::DOUBLE) + ln(c2.n) - ln(h1.n)
      WHEN g.w2 IS NOT NULL THEN 2 * ln(0.4::DOUBLE) + ln(c1.n) - ln(t.n)
      WHEN g.w1 IS NOT NULL AND c2.n >= 2 THEN ln(c2.n) - ln(h1.n)
      WHEN g.w1 IS NOT NULL THEN ln(0.4::DOUBLE) + ln(c1.n) - ln(t.n)
      ELSE ln(c1.n) - ln(t.n) END AS x,
    g.w2 IS NOT NULL AND c3.n >= 2 AS three
  FROM g JOIN c1 ON g.w = c1.w
  LEFT JOIN c2 ON g.w1 = c2.w1 AND g.w = c2.w
  LEFT JOIN c3 ON g.w2 = c3.w2 AND g.w1 = c3.w1 AND g.w = c3.w
  LEFT JOIN c1 AS h1 ON g.w1 = h1.w
  LEFT JOIN c2 AS h2 ON g.w2 = h2.w1 AND g.w1 = h2.w
  CROSS JOIN (SELECT count(*) AS n FROM g) AS t
),
a AS (SELECT r, count(*) AS n, sum(x) AS x, count(*) FILTER (WHERE three) AS three FROM s GROUP BY r)
SELECT doc_id, coalesce(a.n, 0) AS n_tokens, round(coalesce(a.x, 0) / greatest(coalesce(a.n, 0), 1), 5) AS mean_log_score, coalesce(a.three, 0) AS longest
FROM d LEFT JOIN a ON d.r = a.r
"""
