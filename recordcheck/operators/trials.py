"""Suggestions tried out before anybody decides: each by itself, each left out, all in bulk, and all taken back.

An accepted suggestion has to change its own field and nothing else, one that is not accepted has to change nothing. The trials
of a relation of suggestions show which would not.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordcheck.operators.apply import CHANGE, Entry, changed
from recordcheck.operators.review import accept_all, reject_all
from recordcheck.sources.bibtex import first_parts, parse_bibtex

#: Rows of trials that are handed on together.
BATCH = 2048
_TRIED = {"trial": "string", "id": "string", "field": "string", "kind": "string", "to": "string", "text": "string", "result": "string", "applied": "array<string>", "changed": "array<string>"}


def _differing(a: dict[str, str], b: dict[str, str]) -> list[str]:
    return sorted({name for name, _ in a.items() ^ b.items()})


def changed_names(before: str | None, after: str | None) -> list[str]:
    """Fields, in lower case, whose value differs, is new or gone, with KEY and ENTRYTYPE for these; sorted."""
    return _differing(first_parts(before), first_parts(after))


def _tried(text: str, every: list[dict], bulk: list[str], none: list[str]) -> Iterator[tuple]:
    """(trial, suggestion, result, applied, changed) of one citation, whose text is read once."""
    first = next((i for i in parse_bibtex(text) if i["kind"] == "entry"), None)
    entry = Entry(text, first) if first else None
    before = first_parts(text)
    known: dict[tuple[str, ...], tuple] = {}

    def run(taken: list[dict]) -> tuple:
        key = tuple(s["id"] for s in taken)
        if key not in known:
            result, applied, _ = changed(text, entry, taken)
            known[key] = result, applied, [] if result == text else _differing(before, first_parts(result))
        return known[key]

    for s in every:
        yield ("alone", s, *run([s]))
        yield ("without", s, *run([t for t in every if t["id"] != s["id"]]))
    for trial, ids in (("bulk", bulk), ("none", none)):
        yield (trial, None, *run([s for s in every if s["id"] in ids]))


def _records(lists: pa.ListArray) -> list[list[dict]]:
    """Arrays of structs as Python lists, a column at a time: several times faster than value by value."""
    values = lists.flatten()
    names = [values.type.field(k).name for k in range(values.type.num_fields)]
    flat = [dict(zip(names, v)) for v in zip(*(c.to_pylist() for c in values.flatten()))]
    ends = list(accumulate(n or 0 for n in lists.value_lengths().to_pylist()))
    return [flat[start:end] for start, end in zip([0, *ends], ends)]


def trials(entries: DataFrame, suggestions: DataFrame, wanted: tuple[str, ...] = tuple(_TRIED)) -> DataFrame:
    """entries (citation_id, text), suggestions (citation_id, ordinal, id, field, kind, value, term, to, category, grp, accepted) ->
    (citation_id, trial, id, field, kind, to, text, result, applied, changed).

    trial is `alone` (one accepted) or `without` (all others accepted) for each suggestion, and, with a null id, `bulk` (what bulk
    acceptance takes of undecided ones) and `none` (the same taken back) for each citation that has any. Suggestions of one
    citation are a few dozen, so they travel as one array, and its text is read once for all its trials; a citation without a
    text is left out. ids are distinct in a citation. Only the columns that are wanted are made: texts and results of some twenty
    trials are many times the input.
    """
    bulk = accept_all(suggestions.withColumn("accepted", F.lit(None).cast("boolean"))).withColumn("__bulk", F.coalesce("accepted", F.lit(False)))
    taken = reject_all(bulk).withColumn("__none", F.coalesce("accepted", F.lit(False)))
    ids = lambda chosen: F.collect_list(F.when(F.col(chosen), F.col("id")))
    gathered = taken.groupBy("citation_id").agg(F.sort_array(F.collect_list(F.struct(*CHANGE))).alias("every"), ids("__bulk").alias("bulk"), ids("__none").alias("none"))
    rows = entries.filter("text IS NOT NULL").select("citation_id", "text").hint("merge").join(gathered, "citation_id").select("citation_id", "text", "every", "bulk", "none")

    places = [list(_TRIED).index(name) for name in wanted]
    many = [_TRIED[name].startswith("array") for name in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cited: list = []
        made: list[list] = [[] for _ in places]

        def batch(kind: pa.DataType) -> pa.RecordBatch:
            kinds = [pa.list_(pa.string()) if several else pa.string() for several in many]
            done = pa.RecordBatch.from_arrays([pa.array(cited, kind), *[pa.array(c, k) for c, k in zip(made, kinds)]], ["citation_id", *wanted])
            for c in (cited, *made):
                c.clear()
            return done

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                for c, text, every, taken, back in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _records(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist()):
                    for trial, s, result, applied, differing in _tried(text, every, taken, back):
                        of = s or {}
                        row = trial, of.get("id"), of.get("field"), of.get("kind"), of.get("to"), text, result, applied, differing
                        cited.append(c)
                        for column, place in zip(made, places):
                            column.append(row[place])
                    if len(cited) >= BATCH:
                        yield batch(b.schema.field(0).type)
            if cited:
                yield batch(b.schema.field(0).type)

    ddl = ", ".join(f"{name} {_TRIED[name]}" for name in wanted)
    return rows.mapInArrow(run, f"citation_id {entries.schema['citation_id'].dataType.simpleString()}, {ddl}")


def violations(tried: DataFrame) -> DataFrame:
    """Trials (see `trials`) that break a rule, with it: (citation_id, trial, id, rule).

    A suggestion that could not be applied by itself breaks none.
    """
    own = F.when(F.upper("field") == F.col("field"), F.array("field")).otherwise(F.array(F.lower("field")))
    may = F.when(F.col("kind") == "layout", F.array().cast("array<string>")).when(F.col("kind") == "rename", F.concat(own, F.array(F.lower("to")))).otherwise(own)
    alone = (F.col("trial") == "alone") & F.array_contains("applied", F.col("id"))
    same = F.col("result") == F.col("text")
    rule = (
        F.when(alone & same, "an accepted suggestion changes nothing")
        .when(alone & (F.size(F.array_except("changed", may)) > 0), "more than its own field changes")
        .when((F.col("trial") == "without") & F.array_contains("applied", F.col("id")), "a rejected suggestion is applied")
        .when((F.col("trial") == "bulk") & F.array_contains("changed", F.lit("KEY")), "bulk acceptance changes the key")
        .when((F.col("trial") == "none") & ~same, "the text changes with nothing accepted")
    )
    return tried.withColumn("rule", rule).filter("rule IS NOT NULL").select("citation_id", "trial", "id", "rule")
