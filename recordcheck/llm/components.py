"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordcheck.llm.common import materialize


def _stars(edges: DataFrame, large: bool, label: str) -> DataFrame:
    """One half-round over edges (u > v). Minima are pre-aggregated on the map side and stored, so that the join back shuffles
    both sides and AQE can split a node with a large share of the edges."""
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = materialize(least, label)
    met = sides.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        out = met.select(F.explode(pairs).alias("e")).select("e.u", "e.v")
    return out.filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(u, v) long pairs -> (node, root): for every node with a link to a smaller one, the smallest node reachable.

    Roots themselves are not listed. Self-loops and repeated edges are ignored; an empty table gives an empty table.
    Only counts and a checksum reach the driver; each round is written to the shared folder.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, label)
    before = _mark(edges)
    while before[0]:
        edges = materialize(_stars(_stars(edges, True, label), False, label), label)
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
