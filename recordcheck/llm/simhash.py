"""SimHash fingerprints and near-duplicate groups through a Gray-order hierarchical index.

Fingerprints are dealt into buckets so that any two within the radius share at least one (pigeonhole over bit blocks).
Inside a bucket they are sorted by Gray rank; runs of neighbours form nodes that hold the bits all members share, and runs
of nodes form upper nodes. Two nodes whose shared bits already differ too often are pruned with everything below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordcheck.llm.common import join_sized, materialize, table
from recordcheck.llm.components import connected_components

#: Members of a node, and of a bucket's chunk: larger buckets are split into chunks that meet pairwise in tasks of their own.
FANOUT, CHUNK = 8, 1024
#: Node pairs examined at once, and rows gathered before a task works on them.
FRONTIER, GATHER = 1 << 18, 1 << 19
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, repeats included; A-Z lower-cased, words split at ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = list(accumulate(len(p) + 1 for p in parts))
    slices = [joined[a : b - 1] for a, b in zip([0, *ends], ends[words - 1 :])]
    return np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(42)), np.uint64, len(slices))


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; no hashes give 0."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[k : k + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash over word shingles, repeats included."""
    return majority(shingle_hashes(text, words))


def mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Further 64 bits from each hash (the finaliser of splitmix64)."""
    x = hashes + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for every row; null text counts as empty."""
    rows = docs.select(docs[id_col].alias("__id"), docs[text_col].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[id_col, "fp"])

    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def bit_blocks(blocks: int, equal: int) -> list[int]:
    """Masks of every choice of `equal` among `blocks` runs of bits that cover all 64."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(runs, equal)]


def block_choice(count: int, radius: int) -> tuple[int, int]:
    """(blocks, equal) for so many fingerprints: the fewest blocks held equal that leave about a chunk to a bucket. All choices
    find the same links."""
    equal = 1
    while count > CHUNK << (64 * equal // (radius + equal)) and equal < 4:
        equal += 1
    return radius + equal, equal


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    p = np.arange(n)
    while len(a):
        pa_, pb = p[a], p[b]
        low = np.minimum(pa_, pb)
        np.minimum.at(p, pa_, low)
        np.minimum.at(p, pb, low)
        while (q := p[p]).tobytes() != p.tobytes():
            p = q
        open_ = p[a] != p[b]
        a, b = a[open_], b[open_]
    return p


def index_pairs(group: np.ndarray, fps: np.ndarray, radius: int, wide: np.ndarray | None = None, wide_radius: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For fingerprints of several groups: index pairs (a, b) of one group at `radius` or fewer differing bits, a part at a time.

    `group` must be sorted. With `wide`, rows of it must also differ in `wide_radius` or fewer bits.
    """
    n = len(fps)
    order = np.lexsort((gray_rank(fps), group))
    group, sorted_fps = group[order], fps[order]
    levels = [(sorted_fps, np.full(n, ALL), np.arange(n), np.arange(1, n + 1))]  # pattern, mask, first child, end of children
    owner = group
    while len(owner) and (owner[1:] == owner[:-1]).any():
        new = np.r_[True, owner[1:] != owner[:-1]]
        run = np.flatnonzero(new)
        at = np.arange(len(owner)) - run[np.cumsum(new) - 1]
        first = np.flatnonzero(at % FANOUT == 0)
        end = np.r_[first[1:], len(owner)]
        pattern, mask = levels[-1][:2]
        lead = np.repeat(pattern[first], end - first)
        mask = np.bitwise_and.reduceat(mask & ~(pattern ^ lead), first)
        levels.append((pattern[first], mask, first, end))
        owner = owner[first]
    spans = [(np.arange(n), np.arange(1, n + 1))]  # leaves below each node
    for _, _, first, end in levels[1:]:
        lo, hi = spans[-1]
        spans.append((lo[first], hi[end - 1]))
    top = len(levels) - 1
    roots = np.arange(len(owner))
    stack = [(top, roots[k : k + FRONTIER], roots[k : k + FRONTIER], np.zeros(len(roots[k : k + FRONTIER]), np.uint64), np.zeros(len(roots[k : k + FRONTIER]), np.uint8)) for k in range(0, len(roots), FRONTIER)]
    while stack:
        level, a, b, seen, differing = stack.pop()
        pattern, mask, first, end = levels[level]
        both = mask[a] & mask[b]
        fresh = (pattern[a] ^ pattern[b]) & both & ~seen  # bits that no upper pair has counted
        differing = differing + np.bitwise_count(fresh)
        near = differing <= radius
        if level == 0:
            hit = near & (a != b)
            a, b = order[a[hit]], order[b[hit]]
            if wide is not None:
                hit = np.bitwise_count(wide[a] ^ wide[b]).sum(1) <= wide_radius
                a, b = a[hit], b[hit]
            yield a, b
            continue
        sure = near & (wide is None) & (differing + np.bitwise_count(~both) <= radius)  # whatever the free bits are, all pairs link
        lo, hi = spans[level]
        for x, y in ((a[sure], b[sure]), (b[sure], a[sure])):
            size = hi[x] - lo[x]
            leaf = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[x], size)
            yield order[leaf], order[np.repeat(lo[y], size)]  # enough to connect them
        go = near & ~sure
        a, b, seen, differing = a[go], b[go], both[go], differing[go]
        pairs = (end - first)[a] * (end - first)[b]
        step = max(1, FRONTIER // (FANOUT * FANOUT))
        for k in range(0, len(a), step):
            x, y, w = a[k : k + step], b[k : k + step], pairs[k : k + step]
            inner = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            per = np.repeat((end - first)[y], w)
            ca, cb = np.repeat(first[x], w) + inner // per, np.repeat(first[y], w) + inner % per
            ok = (ca <= cb) | np.repeat(x != y, w)
            stack.append((level - 1, ca[ok], cb[ok], np.repeat(seen[k : k + step], w)[ok], np.repeat(differing[k : k + step], w)[ok]))


def index_links(group: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """For fingerprints of several groups: the index of the smallest member that each reaches within its group. `group` must
    be sorted."""
    n = len(fps)
    ids = parent = np.arange(n)
    left, right, waiting = [], [], 0
    for a, b in index_pairs(group, fps, radius):
        left.append(a), right.append(b)
        waiting += len(a)
        if waiting > 1 << 21:
            parent = local_roots(n, np.concatenate([ids, *left]), np.concatenate([parent, *right]))
            left, right, waiting = [], [], 0
    return local_roots(n, np.concatenate([ids, *left]), np.concatenate([parent, *right]))


def _bucket_forest(radius: int):
    """Rows (k, bits, cell, node, fp) sorted by bucket and cell -> edges between nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def work(rows: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]
            root = index_links(np.cumsum(new), np.ascontiguousarray(rows[:, 4]).view(np.uint64), radius)
            linked = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(rows[linked, 3]), pa.array(rows[root[linked], 3])], names=["u", "v"])

        for b in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
            if sum(map(len, held)) >= GATHER:
                rows = np.concatenate(held)
                tail = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
                cut = tail[-1] + 1 if len(tail) else 0
                held = [rows[cut:]]
                if cut:
                    yield work(rows[:cut])
        if held and sum(map(len, held)):
            yield work(np.concatenate(held))

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 4, blocks: int | None = None, equal: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Distinct (node, fp) longs -> edges (u, v) of nodes that connect all that lie within the radius.

    Each bucket gives a forest of its links, never all pairs. `blocks - equal` must be at least the radius; more blocks held
    equal make smaller buckets and more copies. A bucket of over `chunk` members becomes chunks, and every two chunks meet
    in a task of their own.
    """
    blocks = blocks or radius + equal
    if blocks - equal < radius:
        raise ValueError("blocks - equal must reach the radius")
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in bit_blocks(blocks, equal)]
    bucket = [F.struct(F.lit(k).cast("bigint").alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("bits")) for k, m in enumerate(masks)]
    own = ["node", "fp"]
    keys = distinct.select("*", F.explode(F.array(*bucket)).alias("b")).select("b.k", "b.bits", *own)
    large = materialize(keys.groupBy("k", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > chunk), "simhash-large")
    sized = join_sized(keys, large, ["k", "bits"], "left").withColumn("c", F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("bigint"))
    part = F.pmod(F.xxhash64("node"), F.col("c"))
    met = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1), lambda t: F.least(t, part) * F.col("c") + F.greatest(t, part))
    dealt = sized.select("k", "bits", F.explode(met).alias("cell"), *own)
    return dealt.repartition("k", "bits", "cell").sortWithinPartitions("k", "bits", "cell").mapInArrow(_bucket_forest(radius), "u bigint, v bigint")


def near_groups(marked: DataFrame, id_col: str = "doc_id", radius: int = 4, blocks: int | None = None, equal: int = 1) -> DataFrame:
    """Rows with fp -> the same rows with component_id: the smallest id whose fingerprint is reachable.

    Rows without words have fingerprint 0 and link like any other. Null ids are passed over for component_id (null if a
    component has no other); repeated rows share it; other columns are carried along. An empty table gives an empty one.
    `marked` should be a stored table: it is read more than once. Without `blocks`, the number of fingerprints decides.
    """
    firsts = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("__first")), "simhash-firsts")
    blocks, equal = (blocks, equal) if blocks else block_choice(firsts.count(), radius)
    linked = connected_components(fingerprint_links(firsts.select(F.col("fp").alias("node"), "fp"), radius, blocks, equal), "simhash-components")
    named = firsts.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "simhash-named")
    least = materialize(named.groupBy("root").agg(F.min("__first").alias("component_id")), "simhash-least")
    labels = materialize(named.join(least, "root").select(F.col("fp").alias("__node"), "component_id"), "simhash-labels")
    return marked.withColumn("__node", F.col("fp")).join(labels, "__node", "left").drop("__node")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """documents -> the rows that stay: one of each group of near copies, that with the smallest doc_id.

    Near copies have a Jaccard similarity of `similarity` or more over word shingles, and groups are what they connect. Pairs
    are found by SimHash views in the Gray-order index and decided by their shingle sets (`nearcopies`). Rows of one group that also share doc_id are ordered by a hash of the text; rows alike in both
    are alike in all that is compared, and stay together. A row with a null doc_id goes only if its group has another.
    """
    from recordcheck.llm.nearcopies import similar_components

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tied = docs.withColumn("__tie", F.xxhash64(text))
    roots = similar_components(tied.select(F.col("__tie").alias("node"), text.alias("text")), similarity, words)
    rows = tied.select("doc_id", "__tie")
    firsts = rows.groupBy("__tie").agg(F.min("doc_id").alias("__first"))
    named = firsts.join(roots.withColumnRenamed("node", "__tie"), "__tie", "left").withColumn("root", F.coalesce("root", "__tie"))
    named = materialize(named, "near-named")
    least = materialize(named.groupBy("root").agg(F.min("__first").alias("component_id")), "near-least")
    labels = materialize(named.join(least, "root").select("__tie", "component_id"), "near-labels")
    grouped = materialize(rows.join(labels, "__tie"), "near-groups")
    first = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    heads = grouped.filter(first)  # one row for most components: only these need to be told apart
    least = heads.groupBy("component_id").agg(F.min("__tie").alias("__least"))
    tied_heads = heads.join(least, "component_id").filter(F.col("__tie") != F.col("__least")).drop("__least")
    gone = grouped.filter(~first & F.col("component_id").isNotNull()).unionByName(tied_heads)
    gone = gone.select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"), "__tie").distinct()
    gone = materialize(gone, "near-gone")
    keyed = tied.withColumn("__id", F.coalesce("doc_id", F.lit(0))).withColumn("__none", F.col("doc_id").isNull())
    return join_sized(keyed, gone, ["__id", "__none", "__tie"], "left_anti").select(*docs.columns)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    marked = materialize(fingerprints(table(spark, sf_dir, "documents")), "simhash-fingerprints")
    return near_groups(marked).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
