"""Near copies by SimHash: views of a text in the Gray-order index, then exact Jaccard similarity over word shingles.

A view is a SimHash of words, each weighted by the root of its count: one of the whole text, and two for each of its anchors,
of what comes before and after it. Anchors are the places of a text's least shingle hashes, so similar texts mostly have
them in common. Changes all over a text leave few bits of its views different, and a passage that is added, cut or replaced
leaves the other side of an anchor as it was. Views meet in the index at a small radius; there a wide SimHash of the distinct
shingles and the numbers of shingles tell which pairs can be similar, and only those are compared by their shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordcheck.llm.common import join_sized, materialize
from recordcheck.llm.components import connected_components
from recordcheck.llm.simhash import CHUNK, GATHER, bit_blocks, block_choice, index_pairs, majority, mixed, shingle_hashes

#: Anchors of a text, and differing bits at which views meet.
ANCHORS, RADIUS = 4, 3
#: Words of the wide SimHash and its radius: at a similarity of 0.8 38.8 of 256 bits differ, with a deviation of 5.7.
WIDE, WIDE_RADIUS = 4, 50
#: The nearest partners that a member of a bucket is compared with first, and members of a large bucket that meet all others.
NEAREST, PIVOTS = 3, 64
#: Texts whose shingles a task holds at once.
SLICE = 512
#: Bits a shingle of the bitmaps that bound a similarity, their most bytes (longer texts fill them and are bounded less), and
#: rows and bytes of bitmaps that a task gathers before it works on them.
SPREAD, MOST_BYTES, ROWS, BYTES = 8, 1 << 13, 1 << 16, 1 << 26


def views(words: np.ndarray, shingles: np.ndarray, anchors: int = ANCHORS) -> dict[int, set[int]]:
    """Hashes of a text's words and shingles, in order -> its views: of all words (0), before (1) and after (2) an anchor."""
    if not len(words):
        return {0: {0}}
    spans = [(0, 0, len(words))]
    _, first = np.unique(shingles, return_index=True)
    for at in (int(k) + 2 for k in first[:anchors]):
        spans += [s for s in ((1, 0, at), (2, at, len(words))) if 4 * (s[2] - s[1]) >= len(words)]
    distinct, place = np.unique(words, return_inverse=True)
    counts = np.stack([np.bincount(place[a:b], minlength=len(distinct)) for _, a, b in spans])
    weights = np.sqrt(counts)
    bits = np.unpackbits(distinct.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    set_ = weights @ bits * 2 > weights.sum(1, keepdims=True)
    packed = np.packbits(set_, axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()
    found: dict[int, set[int]] = {}
    for (kind, _, _), mark in zip(spans, packed):
        found.setdefault(kind, set()).add(mark)
    return found


def _marks(words: int):
    """Rows (node, text) -> (node, n, kinds, fps, w0, ...): distinct shingles, views by kind, and the wide SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                sizes, kinds, fps, wide = [], [], [], []
                for text in part.column(1).to_pylist():
                    shingles = shingle_hashes(text, words)
                    found = views(shingle_hashes(text, 1), shingles)
                    distinct = np.unique(shingles)
                    sizes.append(len(distinct))
                    kinds.append([kind for kind, of in found.items() for _ in of])
                    fps.append(np.array([x for of in found.values() for x in sorted(of)], np.uint64).view(np.int64))
                    wide.append([majority(mixed(distinct, j + 1)) for j in range(WIDE)])
                w = np.array(wide, np.uint64).reshape(-1, WIDE).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(kinds, pa.list_(pa.int64())), pa.array(fps, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(c)) for c in w.T)],
                    names=["node", "n", "kinds", "fps", *WIDES],
                )

    return run


WIDES = [f"w{k}" for k in range(WIDE)]
MEMBER = ["node", "n", "fp", *WIDES]


def _buckets(batches: Iterator[pa.RecordBatch], work, most: int = GATHER) -> Iterator[pa.RecordBatch]:
    """Calls work on the rows of whole buckets (rows sorted by their first three columns), many at once. A last column that
    isn't of numbers goes along as a list."""
    held: list[np.ndarray] = []
    aside: list[bytes] = []
    for b in batches:
        numbers = [c for c in b.columns if pa.types.is_integer(c.type)]
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in numbers], axis=1))
        if len(numbers) < b.num_columns:
            aside += b.columns[-1].to_pylist()
        if sum(map(len, held)) >= most or sum(map(len, aside)) >= BYTES:
            rows = np.concatenate(held)
            tail = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            cut = tail[-1] + 1 if len(tail) else 0
            if cut:
                yield from work(rows[:cut], aside[:cut])
            held, aside = [rows[cut:]], aside[cut:]
    if held and sum(map(len, held)):
        yield from work(np.concatenate(held), aside)


def _bitmaps(words: int):
    """Rows (node, text) -> (node, bitmap): a bit for each distinct shingle, in a power of two of some SPREAD bits a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part, found = batch.slice(k, SLICE), []
                for text in part.column(1).to_pylist():
                    hashes = np.unique(shingle_hashes(text, words))
                    width = min(8 * MOST_BYTES, 64 << max(0, (SPREAD * len(hashes)).bit_length() - 6))
                    flags = np.zeros(width, bool)
                    flags[hashes & np.uint64(width - 1)] = True
                    found.append(np.packbits(flags, bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["node", "bitmap"])

    return run


def bounded(n: np.ndarray, bitmaps: list[bytes], a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (a, b) of sets with n members and these bitmaps may have the similarity.

    A bit that only one set has is a member that only it has, so a pair that is ruled out cannot have it. Of two bitmaps the
    wider is folded to the other's width.
    """
    widths = np.array([len(x) for x in bitmaps])
    width = np.minimum(widths[a], widths[b])
    ok = np.zeros(len(a), bool)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        used = np.unique(np.r_[a[at], b[at]])
        bits = np.stack([np.bitwise_or.reduce(np.frombuffer(bitmaps[k], np.uint64).reshape(-1, w // 8), axis=0) for k in used.tolist()])
        for k in range(0, len(at), step := max(1, (1 << 22) // w)):
            i, j = a[at[k : k + step]], b[at[k : k + step]]
            x, y = bits[np.searchsorted(used, i)], bits[np.searchsorted(used, j)]
            both = np.minimum(n[i] - np.bitwise_count(x & ~y).sum(1), n[j] - np.bitwise_count(y & ~x).sum(1))
            ok[at[k : k + step]] = both >= similarity * (n[i] + n[j] - both) - 1e-9
    return ok


def _possible(rows: np.ndarray, similarity: float) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Rows (k, bits, cell, *MEMBER, ...) of whole buckets -> their groups, and pairs that may be similar with their distances."""
    group = np.cumsum(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
    node, n = rows[:, 3], rows[:, 4]
    bits = np.ascontiguousarray(rows[:, 5 : 6 + WIDE]).view(np.uint64)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a, b in index_pairs(group, np.ascontiguousarray(bits[:, 0]), RADIUS, bits[:, 1:], WIDE_RADIUS):
            ok = (node[a] != node[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9)
            a, b = a[ok], b[ok]
            yield a, b, np.bitwise_count(bits[a, 1:] ^ bits[b, 1:]).sum(1).astype(np.int64)

    return group, pairs()


def _nearest(similarity: float):
    """Bucket rows -> (u, v) of each member and its nearest partners, and (k, bits) of buckets that hold further pairs."""
    names = ["u", "v", "open"]

    def least(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple:
        """Of pairs given both ways, those nearest to their first member; ties go to the smaller partner."""
        order = np.lexsort((b, d, a))
        a, b, d = a[order], b[order], d[order]
        start = np.searchsorted(a, a)
        kept = np.arange(len(a)) - start < NEAREST
        return a[kept], b[kept], d[kept], a[~kept]

    def work(rows: np.ndarray, _: list[bytes]) -> Iterator[pa.RecordBatch]:
        group, pairs = _possible(rows, similarity)
        best = tuple(np.empty(0, np.int64) for _ in range(3))
        waiting, size, more = [], 0, np.zeros(len(rows), bool)

        def settle() -> None:
            nonlocal best, waiting, size
            a, b, d = (np.concatenate([x[k] for x in waiting]) for k in range(3))
            *best, over = least(len(rows), np.r_[best[0], a, b], np.r_[best[1], b, a], np.r_[best[2], d, d])
            more[over] = True
            waiting, size = [], 0

        for p in pairs:
            waiting.append(p)
            size += len(p[0])
            if size > 1 << 21:
                settle()
        if waiting:
            settle()
        a, b = best[0], best[1]
        x, y = rows[a, 3], rows[b, 3]
        ends = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        left = np.unique(rows[np.isin(group, group[more])][:, :2], axis=0) if more.any() else np.empty((0, 2), np.int64)
        for found, kind in ((ends, False), (left, True)):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), pa.array(np.full(len(found), kind))], names=names)

    return lambda batches: _buckets(batches, work)


def _between_roots(similarity: float):
    """Bucket rows (..., root, side, bitmap) -> (u, v) of all pairs with different roots that may be similar by their bitmaps,
    those between two members of side 1 aside."""

    def work(rows: np.ndarray, bitmaps: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, pairs = _possible(rows, similarity)
        root, side = rows[:, -2], rows[:, -1]
        for a, b, _ in pairs:
            ok = (root[a] != root[b]) & ((side[a] == 0) | (side[a] != side[b]))
            a, b = a[ok], b[ok]
            ok = bounded(rows[:, 4], bitmaps, a, b, similarity)
            x, y = rows[a[ok], 3], rows[b[ok], 3]
            ends = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1), axis=0) if ok.any() else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["u", "v"])

    return lambda batches: _buckets(batches, work, ROWS)


def _sets(words: int):
    """Rows (node, text) -> (node, shingles): the distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                found = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _alike(similarity: float):
    """Rows (u, v, x, y) -> (u, v) of those whose sorted sets have the similarity; two empty sets have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            columns = [(c.flatten().to_numpy(zero_copy_only=False), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column(2), batch.column(3))]
            (xs, xo), (ys, yo) = columns
            for k in range(batch.num_rows):
                x, y = xs[xo[k] : xo[k + 1]], ys[yo[k] : yo[k + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.filter(pa.array(kept, pa.bool_())).select([0, 1])

    return run


def _verified(pairs: DataFrame, rows: DataFrame, similarity: float, words: int) -> DataFrame:
    """Stored pairs (u, v) -> those whose sets have at least the similarity."""
    wanted = materialize(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "near-nodes")
    texts = join_sized(rows, wanted, ["node"], "left_semi").select("node", "text")
    sets = materialize(texts.mapInArrow(_sets(words), "node bigint, shingles array<bigint>").dropDuplicates(["node"]), "near-sets")
    left, right = (sets.select(F.col("node").alias(end), F.col("shingles").alias(own)) for end, own in (("u", "x"), ("v", "y")))
    met = pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y")
    return met.mapInArrow(_alike(similarity), "u bigint, v bigint")


def similar_components(rows: DataFrame, similarity: float = 0.8, words: int = 5, chunk: int = CHUNK) -> DataFrame:
    """(node long, text) -> (node, root): for every node with a similar smaller one, the smallest that links reach.

    Links are pairs of the similarity or more that the index finds. Rows of one node must have one text. `rows` should be a
    stored table: it is read more than once.

    First every member of a bucket is compared with its nearest partners. A bucket of over `chunk` members is dealt into
    chunks, which a few pivots join. Buckets with further pairs come again: all their pairs of still different components
    are compared that their bitmaps leave open. Members of the component that is the commonest in a large bucket do not meet each other there, so that
    one large group of near copies is dealt once; members of other components meet all, in cells of a chunk by a chunk.
    """
    schema = "node bigint, n bigint, kinds array<bigint>, fps array<bigint>, " + ", ".join(f"{w} bigint" for w in WIDES)
    marked = materialize(rows.mapInArrow(_marks(words), schema).dropDuplicates(["node"]), "near-marks")
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in bit_blocks(*block_choice(marked.count(), RADIUS))]
    view = marked.select("*", F.explode(F.arrays_zip("kinds", "fps")).alias("view")).select("node", "n", *WIDES, F.col("view.kinds").alias("kind"), F.col("view.fps").alias("fp"))
    cells = F.array(*[F.struct((F.col("kind") * len(masks) + k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("bits")) for k, m in enumerate(masks)])
    keys = view.select(*MEMBER, F.explode(cells).alias("b")).select("b.k", "b.bits", *MEMBER)
    zero = F.lit(0).cast("bigint")

    large = materialize(keys.groupBy("k", "bits").agg(F.count("*").alias("m")).filter(F.col("m") > chunk), "near-large")
    sized = join_sized(keys, large, ["k", "bits"], "left").withColumn("c", F.coalesce(F.ceil(F.col("m") / chunk), F.lit(1)).cast("bigint"))
    pivot = (F.col("c") > 1) & (F.pmod(F.xxhash64("node", F.lit("pivot")), F.ceil(F.col("m") / PIVOTS).cast("bigint")) == 0)
    cell = F.when(pivot, F.sequence(zero, F.col("c") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("c"))))
    dealt = sized.select("k", "bits", F.explode(cell).alias("cell"), *MEMBER)
    sort = ["k", "bits", "cell"]
    first = materialize(dealt.repartition(*sort).sortWithinPartitions(*sort).mapInArrow(_nearest(similarity), "u bigint, v bigint, open boolean"), "near-first")
    pairs = materialize(first.filter("not open").select("u", "v").distinct(), "near-pairs")
    links = materialize(_verified(pairs, rows, similarity, words), "near-links")
    roots = connected_components(links, "near-components")

    further = first.filter("open").select(F.col("u").alias("k"), F.col("v").alias("bits")).unionByName(large.select("k", "bits")).distinct()
    further = materialize(further, "near-further")
    rooted = join_sized(join_sized(keys, further, ["k", "bits"]), roots, ["node"], "left").select("k", "bits", *MEMBER, F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "near-rooted")
    sizes = rooted.groupBy("k", "bits", "root").agg(F.count("*").alias("m")).groupBy("k", "bits").agg(F.sum("m").alias("all"), F.max(F.struct("m", "root")).alias("most"))
    mixed_ = materialize(sizes.filter(F.col("all") > F.col("most.m")).select("k", "bits", "all", F.col("most.m").alias("most"), F.col("most.root").alias("main")), "near-mixed")
    met = materialize(join_sized(rooted, mixed_, ["k", "bits"]), "near-met")
    wanted = materialize(met.select("node").distinct(), "near-nodes")
    texts = join_sized(rows, wanted, ["node"], "left_semi").select("node", "text")
    bitmaps = materialize(texts.mapInArrow(_bitmaps(words), "node bigint, bitmap binary").dropDuplicates(["node"]), "near-bitmaps")
    whole = F.col("all") <= chunk
    parts = lambda size: F.ceil(size / chunk).cast("bigint")
    met = met.withColumns({"odd": F.col("root") != F.col("main"), "i": parts(F.col("all") - F.col("most")), "j": parts(F.col("most"))}).withColumn("p", F.pmod(F.xxhash64("node"), F.when(F.col("odd"), F.col("i")).otherwise(F.col("j"))))
    place = lambda at, side: F.struct(at.cast("bigint").alias("cell"), F.lit(side).cast("bigint").alias("side"))
    p, i, j = F.col("p"), F.col("i"), F.col("j")
    among = F.transform(F.sequence(zero, i - 1), lambda t: place(F.least(t, p) * i + F.greatest(t, p), 0))
    across = F.transform(F.sequence(zero, j - 1), lambda t: place(i * i + p * j + t, 1))
    main = F.transform(F.sequence(zero, i - 1), lambda t: place(i * i + t * j + p, 2))
    places = F.when(whole, F.array(place(F.lit(0), 0))).when(F.col("odd"), F.concat(among, across)).otherwise(main)
    dealt = met.select("k", "bits", F.explode(places).alias("at"), *MEMBER, "root").select("k", "bits", "at.cell", *MEMBER, "root", "at.side")
    dealt = dealt.join(bitmaps, "node").select("k", "bits", "cell", *MEMBER, "root", "side", "bitmap")
    again = dealt.repartition(*sort).sortWithinPartitions(*sort).mapInArrow(_between_roots(similarity), "u bigint, v bigint").distinct()
    rest = materialize(again.join(pairs, ["u", "v"], "left_anti"), "near-rest")
    return connected_components(links.unionByName(_verified(rest, rows, similarity, words)), "near-components")
