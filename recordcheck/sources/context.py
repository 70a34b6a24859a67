"""Entries read apart from the list they were chosen from: its definitions and its entries stay their context.

A text of its own has few definitions and rarely the entries that its own one names. Both are joined from the list: macros by
iterated joins, parents by key. A list is never attached to an entry as a whole, so an entry costs what it names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordcheck.sources.bibtex import entries, fields, first_fields, references, strings
from recordcheck.sources.macros import items_with_definitions, with_definitions
from recordcheck.storage import stored


@dataclass(frozen=True)
class Context:
    """The parsed lists, with the list as file_id, and from which of them each text comes: (file_id, library), one for a text."""

    library: DataFrame
    links: DataFrame

    def definitions(self) -> DataFrame:
        return strings(self.library).withColumnRenamed("file_id", "library")


def items_in_context(parsed: DataFrame, context: Context) -> DataFrame:
    """Items with field texts under their own definitions and, where they have none, under those of their list.

    A text without a link has only its own definitions.
    """
    return items_with_definitions(parsed, context.definitions(), context.links)


def parents_in_context(parsed: DataFrame, context: Context) -> DataFrame:
    """Fields (file_id, pos, type, key, field_pos, name, text, ...) of the entries of the lists that texts' entries name, for
    each text that names them.

    The first entry of a key counts, keys are compared without case, and a parent's macros are those of the text before those
    of the list. A null key names nothing. Only named entries are joined, and their macros alone expanded.
    """
    named = references(first_fields(fields(parsed))).select("file_id", "ref").distinct()
    first = entries(context.library).groupBy(F.col("file_id").alias("library"), F.lower("key").alias("ref")).agg(F.min("pos").alias("pos"))
    met = named.join(context.links.select("file_id", "library"), "file_id").join(first, ["library", "ref"]).select("file_id", "library", "pos")
    theirs = fields(context.library).withColumnRenamed("file_id", "library")
    rows = stored(theirs.join(met, ["library", "pos"]).drop("library"), "context-parents")
    return with_definitions(rows, strings(parsed), context.definitions(), context.links)
