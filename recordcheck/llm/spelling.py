"""Spelling variants by a dictionary of pairs of trie nodes.

The dictionary's words stand in a trie, and their reversals in another; the nodes of both are numbered. A word cut at a position
is a pair of integers: the node of what comes before and the node of what comes after. Two kinds of pairs are listed:

* gap pairs leave out nothing, so a pair names the word itself, cut at a position;
* skip pairs leave out the one code point at a position.

Words with a skip pair in common differ by a replaced code point there; a word whose skip pair is another's gap pair is that
other word with one code point inserted. A code point that repeats the one before gives the same word when it is left out, so
only the first of a run meets gap pairs: every two near words then meet in exactly one pair, and counts need no distinct. A pair
is shared by one word and its insertions at a place, so by as many as the alphabet has letters and one more.

Tries are numbered from sorted words, where a word's new nodes are those beyond the beginning it shares with the word before.
Parts of the sorted words are numbered in tasks of their own, after a fold over the parts' first and last words gives each part its
first number and the nodes it takes over. Nodes that hold one word only join nothing and are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordcheck.llm.common import materialize, table

#: Words of a part of the sorted dictionary, on average; code points of a text that are looked at together; words counted before they are sent on.
PART_WORDS, SLICE, HELD = 1 << 15, 1 << 20, 1 << 18
ALPHABET = "a-zÀ-ÿ"


def slices(text: str, letters: re.Pattern) -> Iterator[str]:
    """A text in pieces of about SLICE code points that end where a run of letters does not go on."""
    start = 0
    while start < len(text):
        end = letters.match(text, min(start + SLICE, len(text))).end()
        yield text[start:end]
        start = end


def count_runs(least: int, change: Callable[[object, bytes], int | None] | None):
    """Batches of (id, text) -> (word, n), summed up within a task as far as HELD words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, letters = re.compile(f"[{ALPHABET}]{{{least},}}"), re.compile(f"[{ALPHABET}]*")
        counts: Counter = Counter()
        send = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for id_, raw in zip(b.column(0), b.column(1).cast(pa.large_binary() if pa.types.is_large_string(b.column(1).type) else pa.binary())):
                if not raw.is_valid:
                    continue
                for piece in slices(raw.as_py().lower().decode(), letters):  # bytes.lower() changes A-Z alone
                    for word, n in Counter(long.findall(piece)).items():
                        cut = change(id_.as_py(), word.encode()) if change else None
                        if cut is not None:
                            at = cut % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least:
                            counts[word] += n
                if len(counts) >= HELD:
                    yield send()
                    counts.clear()
        yield send()

    return run


def dictionary(docs: DataFrame, least_length: int = 6, least_count: int = 5, change=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts of at least so many code points and occurrences; stored.

    Words are the longest runs of letters, with A-Z in lower case. change(id, run in UTF-8) may give a number whose remainder by
    the run's length is the position of a code point to leave out. Runs shorter than least_length are never words.
    """
    found = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(count_runs(least_length, change), "word string, n bigint")
    return materialize(found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count), "spelling-words")


def shared(a: str, b: str) -> int:
    """Code points of the longest common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def new_nodes(words: list[str]) -> tuple[list[list[int]], list[int], int]:
    """Sorted words -> for each the numbers of its trie nodes, one a code point, the beginning it shares with the word before, and the count of nodes."""
    paths, commons, total, before, path = [], [], 0, "", []
    for w in words:
        common = shared(before, w)
        path = path[:common] + list(range(total, total + len(w) - common))
        total += len(w) - common
        paths.append(path)
        commons.append(common)
        before = w
    return paths, commons, total


ENDS = "part int, first string, last string, words bigint, nodes bigint, path array<bigint>"
STARTS = "part int, rank bigint, base bigint, taken array<bigint>, after bigint"


def _ends(rows: pa.Table) -> pa.Table:
    keys = rows.column("key").sort().to_pylist()
    paths, _, total = new_nodes(keys)
    return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "first": [keys[0]], "last": [keys[-1]], "words": [len(keys)], "nodes": [total], "path": pa.array([paths[-1]], pa.list_(pa.int64()))})


def starts(ends: list) -> list[tuple[int, int, int, list[int], int]]:
    """First and last words of the parts, in order -> each part's first rank and node, nodes taken over, and beginning shared with the next part."""
    rank, base, last, path, out = 0, 1, "", [], []
    for e, following in zip(ends, [*ends[1:], None]):
        taken = path[: shared(last, e["first"])]
        out.append((e["part"], rank, base, taken, shared(e["last"], following["first"]) if following else 0))
        path = [taken[n] if n < len(taken) else base + n - len(taken) for n in e["path"]]
        rank, base, last = rank + e["words"], base + e["nodes"] - len(taken), e["last"]
    return out


def _number(rows: pa.Table, start: pa.Table) -> pa.Table:
    """A part's words -> rank, and numbers of the nodes, from the root on, that hold other words too."""
    rows, start = rows.sort_by("key"), start.to_pylist()[0]
    keys, taken, base = rows.column("key").to_pylist(), start["taken"], start["base"]
    paths, commons, _ = new_nodes(keys)
    commons[0] = len(taken)
    nodes = [[0, *(taken[n] if n < len(taken) else base + n - len(taken) for n in path[: max(common, following)])] for path, common, following in zip(paths, commons, [*commons[1:], start["after"]])]
    return pa.table({"word": rows.column("word"), "rank": pa.array(range(start["rank"], start["rank"] + len(keys)), pa.int64()), "nodes": pa.array(nodes, pa.list_(pa.int64()))})


def trie_nodes(words: DataFrame, key: Column) -> DataFrame:
    """(word, rank, nodes): each word's place in the order of `key`, and the numbers of the trie nodes of key's beginnings, from
    the root (0) to the deepest that another word shares.

    One row of each part of some PART_WORDS words reaches the driver: its first and last word.
    """
    parts = max(1, words.count() // PART_WORDS)
    dealt = words.select("word", key.alias("key")).repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "spelling-sorted")
    ends = sorted(dealt.groupBy("part").applyInArrow(_ends, ENDS).collect(), key=lambda e: e["part"])
    begin = words.sparkSession.createDataFrame(starts(ends), STARTS)
    return dealt.groupBy("part").cogroup(begin.groupBy("part")).applyInArrow(_number, "word string, rank bigint, nodes array<bigint>")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their nodes in both tries -> (before, after, id, n, skips, first): their pairs of nodes."""
    for b in batches:
        out: list[tuple] = []
        for r in b.to_pylist():
            word, fore, back, size = r["word"], r["fore"], r["back"], len(r["word"])
            for i in range(max(0, size - 1 - (len(back) - 1)), min(size, len(fore))):
                out.append((fore[i], back[size - 1 - i], r["id"], r["n"], True, i == 0 or word[i] != word[i - 1]))
            for i in range(max(0, size - (len(back) - 1)), min(size + 1, len(fore))):
                out.append((fore[i], back[size - i], r["id"], r["n"], False, False))
        kinds = (pa.int64(),) * 4 + (pa.bool_(),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=["before", "after", "id", "n", "skips", "first"])


def near_words(words: DataFrame) -> DataFrame:
    """(id, word, n, n_near, best): each word's rank as id, the count of words at distance 1, and of those more frequent than it
    (ties: with a smaller rank) the one of largest n, as struct (n, order) with order = -id; null if there is none. Stored."""
    fore = trie_nodes(words, F.col("word")).select("word", F.col("rank").alias("id"), F.col("nodes").alias("fore"))
    back = trie_nodes(words, F.reverse("word")).select("word", F.col("nodes").alias("back"))
    entries = materialize(words.join(fore, "word").join(back, "word"), "spelling-entries")
    pairs = entries.mapInArrow(_pairs, "before bigint, after bigint, id bigint, n bigint, skips boolean, first boolean")
    met, word = Window.partitionBy("before", "after"), F.struct("n", (-F.col("id")).alias("order"))
    over = lambda which: (F.count(F.when(which, 1)).over(met), F.max(F.when(which, word)).over(met))
    (skips, skipped), (firsts, longer), (gaps, shorter) = over(F.col("skips")), over(F.col("first")), over(~F.col("skips"))
    replaced = F.struct((skips - 1).alias("near"), skipped.alias("best"))
    inserted = F.struct(firsts.alias("near"), longer.alias("best"))
    left_out = F.struct((gaps * F.col("first").cast("int")).alias("near"), F.when(F.col("first"), shorter).alias("best"))
    none = F.struct(F.lit(0).cast("bigint").alias("near"), F.lit(None).cast(entries.select(word.alias("w")).schema["w"].dataType).alias("best"))
    links = pairs.select("id", word.alias("own"), F.when(F.col("skips"), replaced).otherwise(inserted).alias("x"), F.when(F.col("skips"), left_out).otherwise(none).alias("y"))
    more = lambda c: F.when(F.col(c) > F.col("own"), F.col(c))
    links = links.filter("x.near + y.near > 0").groupBy("id").agg(F.sum(F.expr("x.near + y.near")).alias("n_near"), F.max(F.greatest(more("x.best"), more("y.best"))).alias("best"))
    found = entries.select("id", "word", "n").join(links, "id", "left")
    return materialize(found.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "best"), "spelling-near")


def roots(forms: DataFrame) -> DataFrame:
    """(id, form) of words that have a form -> (id, root): where following the forms ends.

    Forms are more frequent than their words, so there are no circles; each round doubles the steps that are taken at once and
    is stored, and only a count reaches the driver.
    """
    known = materialize(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = known.select(F.col("id").alias("root"), F.col("root").alias("__next"))
        further = known.join(on, "root", "left").select("id", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved"))
        known = materialize(further, "spelling-roots")
        if known.filter("__moved").limit(1).count() == 0:
            return known.select("id", "root")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, change=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): the dictionary of docs, each word with its usual form.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of
    largest n, ties by code-point order, if that n is at least `ratio` (2 or more) times the word's own; else null. root is
    where the forms lead to, the word itself if it has none. See `dictionary` for words and `change`.

    Null texts have no words; a null id reaches `change` as None. Repeated rows count each time. Other columns are not read.
    Empty tables give no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = near_words(dictionary(docs, least_length, least_count, change, id_col, text_col))
    usual = F.col("best.n") >= ratio * F.col("n")
    formed = words.select("id", "word", "n", "n_near", F.when(usual, -F.col("best.order")).alias("form_id"), F.when(usual, F.col("best.n")).alias("form_n"))
    lead = roots(formed.filter("form_id IS NOT NULL").select("id", F.col("form_id").alias("form")))
    name = lambda key, as_: words.select(F.col("id").alias(key), F.col("word").alias(as_))
    found = formed.join(lead.withColumnRenamed("root", "root_id"), "id", "left")
    found = found.join(name("form_id", "form"), "form_id", "left").join(name("root_id", "__root"), "root_id", "left")
    return found.select("word", "form", F.coalesce("__root", "word").alias("root"), "n", "n_near", "form_n")


def misspelt(modulus: int = 199):
    """The change that plants a misspelling: the crc32 of `<id>:<run>` where the modulus divides it; none for a null id."""

    def change(id_, run: bytes) -> int | None:
        if id_ is None:
            return None
        found = zlib.crc32(run, zlib.crc32(f"{id_}:".encode()))
        return found if found % modulus == 0 else None

    return change


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), change=misspelt())
