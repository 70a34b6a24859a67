"""Which titles may be similar: a prefix filter over words with bounds on lengths and places, and a join along the sorted order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordcheck.functions.text import EDIT_CHARS, FORGIVEN_CHARS, words
from recordcheck.operators.prefixes import prefix_pairs


def rare_tokens(rows: DataFrame, id_col: str, dice: float, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, id, norm_title) -> (within, id, token, at, tokens): of each title its rarest tokens, enough to meet any title of that Dice
    similarity, with their places in that order and the count of all.

    Two token sets of a Jaccard similarity of at least j share one of the first n - ceil(j n) + 1 tokens of either, in any
    common order; by rarity, the words that many titles have are seldom keys. Repeats of a word are numbered, as Dice counts
    them. within: columns in which two titles must be equal; tokens are counted for each of their values.
    """
    listed = words("norm_title")
    numbered = F.transform(listed, lambda w, i: F.concat_ws("\n", w, F.nullif(F.size(F.filter(F.slice(listed, F.lit(1), i), lambda x: x == w)), F.lit(0)).cast("string")))
    tokens = rows.select(*within, id_col, F.explode(numbered).alias("token"))
    counts = tokens.groupBy(*within, "token").agg(F.count("*").alias("n"))
    jaccard = dice / (2 - dice)
    listed = tokens.join(counts, [*within, "token"]).groupBy(*within, id_col).agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    keep = F.size("t") - F.ceil(F.size("t") * jaccard - 1e-9) + 1
    return listed.select(*within, id_col, F.posexplode(F.slice("t", F.lit(1), keep.cast("int"))["token"]).alias("at", "token"), F.size("t").alias("tokens"))


def may_be_similar(least: float) -> Column:
    """Of titles a and b that share a token, the first one they share: whether the blend of tokens and edits can reach `least`.

    Both have the token at a place of one common order, so they share no more than it and what is behind it in the shorter rest;
    an edit similarity is at most the ratio of the lengths, where no title is cut.
    """
    common = F.least(F.col("tokens_a") - F.col("at_a"), F.col("tokens_b") - F.col("at_b"))  # `at` counts from 0
    dice = 2.0 * common / (F.col("tokens_a") + F.col("tokens_b"))
    a, b = F.char_length("title_a"), F.char_length("title_b")
    edit = F.when(F.greatest(a, b) > EDIT_CHARS, 1.0).otherwise(F.least(a, b) / F.greatest(a, b))
    return 0.6 * dice + 0.4 * edit >= least - 1e-9


def title_pairs(left: DataFrame, right: DataFrame, least: float, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, norm_title) of two sides -> (within, title_a, title_b): all distinct pairs of a similarity of at least `least`, and some more.

    Pairs share a rare token and pass `may_be_similar`, or, as a title that begins another is forgiven the rest, one begins with the
    other. Empty and missing titles are in no pair.
    """
    dice = max(0.0, (least - 0.4) / 0.6)
    a, b = (df.select(*within, "norm_title").filter("norm_title <> ''").distinct() for df in (left, right))
    # One order of tokens for both sides.
    sides = a.select(F.lit("a").alias("side"), *within, "norm_title").unionByName(b.select(F.lit("b").alias("side"), *within, "norm_title"))
    keys = rare_tokens(sides.withColumn("key", F.struct("side", "norm_title")), "key", dice, within)
    of = lambda side: keys.filter(F.col("key.side") == side).select(*within, "token", F.col("key.norm_title").alias(f"title_{side}"), F.col("at").alias(f"at_{side}"), F.col("tokens").alias(f"tokens_{side}"))
    pairs = of("a").join(of("b"), [*within, "token"]).filter(may_be_similar(least)).select(*within, "title_a", "title_b")
    # Titles stand behind what they must have in common, as JSON on a line of its own, so that one sorted order serves all.
    head = F.concat(F.to_json(F.struct(*within)), F.lit("\n")) if within else F.lit("")
    long = lambda df: df.filter(F.char_length("norm_title") >= FORGIVEN_CHARS).select(F.concat(head, F.col("norm_title")).alias("text"))
    begun = prefix_pairs(long(a), long(b))
    if within:
        kind = F.struct(*[F.col(c) for c in within])
        schema = left.select(kind.alias("k")).schema["k"].dataType
        rest = lambda c: F.expr(f"substr({c}, instr({c}, '\n') + 1)")
        begun = begun.select(F.from_json(F.substring_index("a", "\n", 1), schema).alias("k"), rest("a").alias("title_a"), rest("b").alias("title_b")).select(*[F.col("k")[c].alias(c) for c in within], "title_a", "title_b")
    else:
        begun = begun.select(F.col("a").alias("title_a"), F.col("b").alias("title_b"))
    return pairs.unionByName(begun).distinct()
