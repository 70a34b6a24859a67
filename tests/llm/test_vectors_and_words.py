"""Hard negatives, exact top-k search and spelling variants against plain versions, and on awkward rows."""

import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import SF  # noqa: E402

from recordcheck.llm import negatives, spelling, topk, vectors  # noqa: E402

VECTORS = "vec_id long, embedding array<double>, label int, row string, score string, id string"
NAN, INF = float("nan"), float("inf")


def awkward_vectors():
    """Nulls and non-finite values everywhere, repeated rows, ties, other lengths, huge values and clashing names."""
    r = random.Random(3)
    rows = [(k, [r.randint(-2, 2) / 4 for _ in range(4)], k % 3) for k in range(120)]
    rows += [(50, [0.5, 0.25, 0.0, 0.25], 2), (50, [0.5, 0.25, 0.0, 0.25], 2), (7, [0.25] * 4, 1), (None, [1.0] * 4, 1), (200, None, 1), (201, [1.0, None, 1.0, 1.0], 1), (202, [1.0, NAN, 1.0, 1.0], 1)]
    rows += [(203, [1.0, INF, 1.0, 1.0], 1), (204, [], 0), (205, [1.0], 1), (206, [0.0] * 4, 2), (250, [0.25, 0.5], 1), (207, [1e300, 1.0], 0), (208, [1e306] * 2, 0), (209, [0.5] * 6, None), (300, [-1.0] * 4, 0)]
    return [(i, v, label, "own", "own", "own") for i, v, label in rows]


def whole(rows):
    """(id, label, numbers) of the rows that take part."""
    out = []
    for i, v, label, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x * 256) for x in v):
            out.append((i, label, [int(np.floor(x * 256)) for x in v]))
    return out


def inner(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward_vectors(), VECTORS)


@pytest.mark.parametrize("queries, rows", [(1024, 4096), (3, 10)])
def test_top_k_on_awkward_rows(spark, odd, monkeypatch, queries, rows):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", queries)
    monkeypatch.setattr(vectors, "ROW_BLOCK", rows)
    held = whole(awkward_vectors())
    want = []
    for n, (i, _, v) in enumerate(held):
        if i % 50 == 0:
            best = sorted(((-inner(v, w), j) for m, (j, _, w) in enumerate(held) if m != n))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    got = topk.top_k(odd, F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("queries, rows", [(1024, 4096), (2, 9)])
def test_negatives_on_awkward_rows(spark, odd, monkeypatch, queries, rows):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", queries)
    monkeypatch.setattr(vectors, "ROW_BLOCK", rows)
    held = [x for x in whole(awkward_vectors()) if x[1] is not None]
    want = []
    for n, (i, label, v) in enumerate(held):
        if i % 10 == 0:
            scored = sorted((-inner(v, w), j, own == label) for m, (j, own, w) in enumerate(held) if m != n)
            for s, j, _ in [x for x in scored if x[2]][:5]:
                found = [(-t, k) for t, k, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
                want += [(i, j, rank + 1, k, -s, t) for rank, (t, k) in enumerate(found)]
    got = negatives.hard_negatives(odd, F.col("vec_id") % 10 == 0, F.col("label"))
    assert len(want) > 20 and sorted(map(tuple, got.collect())) == sorted(want)


def test_no_vectors(spark, odd):
    none = odd.limit(0)
    assert topk.top_k(none, F.col("vec_id") % 50 == 0).count() == 0 and topk.top_k(odd, F.lit(False)).count() == 0
    assert negatives.hard_negatives(none, F.lit(True), F.col("label")).count() == 0 and negatives.hard_negatives(odd, F.lit(None).cast("boolean"), F.col("label")).count() == 0


def test_keys_sort_as_pairs_do():
    r = random.Random(1)
    pairs = [(r.randrange(3), r.choice([-5, 0, 5, 2**63 - 1, -(2**63)]), r.random() < 0.5, r.choice([-3, 0, 4, -(2**63), 2**63 - 1]), r.randrange(4)) for _ in range(500)]
    assert [negatives.unpack_key(negatives.pack_key(*p)) for p in pairs] == [p[:4] for p in pairs]
    assert sorted(pairs, key=lambda p: negatives.pack_key(*p)) == sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3], p[4]))


def test_windows():
    for p in range(-40, 60):
        low, high = negatives.window(p, 50, 95)
        assert [s for s in range(-100, 100) if 50 * p <= 100 * s <= 95 * p] == list(range(low, high + 1))


def test_exact_scores_beyond_doubles():
    big = pa.chunked_array([[[3e15, 1.0], [1.0, -1.0]]], pa.list_(pa.float64()))
    a = vectors.whole_numbers(big)
    assert vectors.exact_kind(a, a) is object and vectors.exact_kind(a[1:], a[1:]) is np.int64
    scores = topk.accumulate(vectors.as_kind(a, object)[0], topk.postings(vectors.as_kind(a, object)), np.zeros(2, object))
    assert scores.tolist() == [(int(3e15) * 256) ** 2 + 65536, int(3e15) * 65536 - 65536]


# ---- spelling ----
def plain_variants(docs, least=6, many=5, ratio=5, modulus=199):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % modulus == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= many}
    near, masks = defaultdict(set), defaultdict(list)
    for w in words:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
            masks[w[:k], w[k + 1 :]].append(w)
    for group in masks.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= ratio * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_spelling_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(spelling.op12_spelling(spark, SF)) == plain_variants(docs)


def test_spelling_in_small_parts(spark, monkeypatch):
    """Words over few letters have many neighbours; parts of a few words take over each other's nodes."""
    r = random.Random(8)
    monkeypatch.setattr(spelling, "PART_WORDS", 5)
    monkeypatch.setattr(spelling, "HELD", 50)
    monkeypatch.setattr(spelling, "SLICE", 100)
    words = ["".join(r.choice("abé") for _ in range(r.choice((5, 6, 6, 7, 7, 8)))) for _ in range(350)]
    docs = []
    for i in range(60):
        text = " ".join(r.choice(words[: r.choice((5, 40, 350))]).upper() if r.random() < 0.2 else r.choice(words) for _ in range(100))
        docs.append((i, text))
    docs += [(None, "Aaaaaab " * 9), (60, None), (61, ""), (62, "z" * 5000 + " " + "z" * 4999), (62, "x÷y×aaaaaa " * 9), (63, "😀abcabcabc1abcabcabc_Àbcabcabc " * 7), (63, "😀abcabcabc1abcabcabc_Àbcabcabc " * 7)] + [(70 + k, "z" * 5000) for k in range(6)]
    df = spark.createDataFrame([(i, t, "own", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    for modulus in (7, 199):
        got, want = rows_of(spelling.spelling_variants(df, change=spelling.misspelt(modulus))), plain_variants(docs, modulus=modulus)
        assert len(want) > 60 and got == want
    assert any(w[1] and w[1] != w[2] for w in want) or any(w[1] for w in want)
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, ratio=1)


def test_trie_nodes_are_numbered_once(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART_WORDS", 3)
    words = sorted({"abcabc", "abcabd", "abcab", "abx", "b", "ba", "bab", "babb", "babbb", "babc", "c", "cabcab"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    rows = spelling.trie_nodes(df, F.col("word")).orderBy("rank").collect()
    assert [r["word"] for r in rows] == words and [r["rank"] for r in rows] == list(range(len(words)))
    of = defaultdict(set)
    for r in rows:
        for depth, node in enumerate(r["nodes"]):
            of[node].add(r["word"][:depth])
    assert all(len(p) == 1 for p in of.values()) and len(of) == len(set().union(*of.values()))
    shared = {w[:d] for w in words for d in range(len(w) + 1) if sum(x.startswith(w[:d]) for x in words) > 1}
    assert set().union(*of.values()) == shared
