"""Which texts begin with which others: a join along the sorted order.

In sorted order the texts that begin with p stand together right behind p. Sorted texts are cut into parts; a task goes through
a part with a stack of the texts that the current one begins with, so that pairs are made from the stack alone and as many as there are
hits. What a part's stack holds at its begin are those beginnings of its first text that are texts themselves: an equal-join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordcheck.storage import stored

#: Texts of a part, on average.
PART_TEXTS = 1 << 15


def _walk(rows: pa.Table, above: pa.Table) -> pa.Table:
    """A part's texts and the stack at its begin -> pairs of which one begins with the other."""
    listed = lambda t: zip(*(t.sort_by("text").column(c).to_pylist() for c in ("text", "left", "right")))
    stack, a, b = list(listed(above)), [], []
    for text, left, right in listed(rows):
        while stack and not text.startswith(stack[-1][0]):
            stack.pop()
        stack.append((text, left, right))
        if left:
            hits = [s for s, _, also in stack if also]
            a += [text] * len(hits)
            b += hits
        if right:
            hits = [s for s, also, _ in stack[:-1] if also]
            a += hits
            b += [text] * len(hits)
    return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})


def prefix_pairs(left: DataFrame, right: DataFrame, least: int = 1, part_texts: int = PART_TEXTS) -> DataFrame:
    """(text), (text) -> (a, b), a of the left and b of the right: the distinct pairs of which one begins with the other.

    Equal texts are a pair. Texts of fewer than `least` characters, and nulls, take no part.
    """
    side = lambda df, is_left: df.select("text", F.lit(is_left).alias("left"), F.lit(not is_left).alias("right"))
    texts = side(left, True).unionByName(side(right, False)).filter(F.char_length("text") >= least)
    texts = texts.groupBy("text").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    texts = stored(texts, "prefix-texts")
    parts = max(1, texts.count() // part_texts)
    if parts == 1:  # one sorted part has no others before it
        alone = texts.withColumn("part", F.lit(0))
        return alone.groupBy("part").cogroup(stored(alone.limit(0), "prefix-above").groupBy("part")).applyInArrow(_walk, "a string, b string")
    dealt = stored(texts.repartitionByRange(parts, "text").withColumn("part", F.spark_partition_id()), "prefix-parts")
    first = dealt.groupBy("part").agg(F.min("text").alias("first"))
    heads = first.filter(F.char_length("first") > least).select("part", F.explode(F.transform(F.sequence(F.lit(least), F.char_length("first") - 1), lambda n: F.substring("first", F.lit(1), n))).alias("text"))
    above = stored(heads.join(texts, "text").select("part", "text", "left", "right"), "prefix-above")
    return dealt.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(_walk, "a string, b string")
