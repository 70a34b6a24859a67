"""The state of a review: nothing is accepted by itself, alternatives of a group exclude one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sections of a review, in order.
SECTIONS = (("conflict", "Corrections"), ("version", "Published version"), ("missing", "Missing information"), ("url", "Links"), ("format", "Formatting"), ("key", "Citation key"))


def decision_key(suggested: str = "suggested") -> Column:
    """What stays the same when suggestions are made anew."""
    return F.concat_ws("|", F.col("field"), F.col("kind"), F.col(suggested))


def needs_own_decision() -> Column:
    """Changes that bulk acceptance leaves alone."""
    return F.col("category").isin("key", "version")


def decide(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """One decision (citation_id, id, decision) for a citation. Accepting takes back what was accepted in the same group;
    undecided alternatives stay undecided."""
    target = decisions.join(suggestions.select("citation_id", "id", F.col("grp").alias("target_grp")), ["citation_id", "id"]).select("citation_id", F.col("id").alias("target"), "decision", "target_grp")
    rows = suggestions.join(target, "citation_id", "left")
    rival = F.coalesce(F.col("decision") & (F.col("grp") == F.col("target_grp")) & F.col("accepted"), F.lit(False))
    accepted = F.when(F.coalesce(F.col("id") == F.col("target"), F.lit(False)), F.col("decision")).when(rival, F.lit(False)).otherwise(F.col("accepted"))
    return rows.withColumn("accepted", accepted).drop("target", "decision", "target_grp")


def accept_all(suggestions: DataFrame) -> DataFrame:
    """All undecided ones but those that need their own decision; of a group the first, if none was accepted before."""
    group = Window.partitionBy("citation_id", F.coalesce("grp", F.concat(F.lit("\x00"), F.col("ordinal").cast("string"))))
    open_ = ~needs_own_decision() & F.col("accepted").isNull()
    rows = suggestions.withColumns({"__taken": F.max(F.coalesce(F.col("accepted"), F.lit(False))).over(group), "__first": F.min(F.when(open_, F.col("ordinal"))).over(group)})
    lone = F.col("grp").isNull() | (F.col("grp") == "")
    chosen = open_ & (lone | (~F.col("__taken") & (F.col("ordinal") == F.col("__first"))))
    return rows.withColumn("accepted", F.when(chosen, True).otherwise(F.col("accepted"))).drop("__taken", "__first")


def reject_all(suggestions: DataFrame) -> DataFrame:
    return suggestions.withColumn("accepted", F.lit(False))


def set_version_changes(suggestions: DataFrame, decision: bool | None) -> DataFrame:
    """One decision for all version changes, as if made one after another: of a group the last stays accepted."""
    version = F.col("category") == "version"
    if decision is not True:
        return suggestions.withColumn("accepted", F.when(version, F.lit(decision)).otherwise(F.col("accepted")))
    group = Window.partitionBy("citation_id", "grp")
    grouped = F.coalesce(F.col("grp") != "", F.lit(False))
    last = F.max(F.when(version, F.col("ordinal"))).over(group)
    rows = suggestions.withColumn("__last", last)
    value = (
        F.when(version & (~grouped | (F.col("ordinal") == F.col("__last"))), True)
        .when(grouped & F.col("__last").isNotNull() & (version | F.col("accepted")), False)
        .otherwise(F.col("accepted"))
    )
    return rows.withColumn("accepted", value).drop("__last")


def carry_decisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """New suggestions with the decisions made on those of the same key; of several the last."""
    made = before.filter("accepted IS NOT NULL").withColumn("key", decision_key())
    last = made.groupBy("citation_id", "key").agg(F.max_by("accepted", "ordinal").alias("carried"))
    rows = after.withColumn("key", decision_key()).join(last, ["citation_id", "key"], "left")
    return rows.withColumn("accepted", F.coalesce("carried", "accepted")).drop("key", "carried")


def counts(suggestions: DataFrame) -> DataFrame:
    return suggestions.groupBy("citation_id").agg(
        F.count("*").alias("total"), F.count_if("accepted").alias("accepted_n"), F.count_if(~F.col("accepted")).alias("rejected_n"), F.count_if(F.col("accepted").isNull()).alias("undecided_n")
    )


def by_section(suggestions: DataFrame) -> DataFrame:
    """Suggestions with place and title of their section, in review order."""
    place = F.create_map(*[F.lit(x) for k, (name, _) in enumerate(SECTIONS) for x in (name, k)])
    title = F.create_map(*[F.lit(x) for name, t in SECTIONS for x in (name, t)])
    return suggestions.withColumns({"section_place": F.element_at(place, F.col("category")), "section": F.element_at(title, F.col("category"))})


# Marks of a line on the proof sheet, the most severe first.
MARKS = ("bad", "warn", "info", "pencil", "good")


def line_marks(marks: DataFrame) -> DataFrame:
    """(citation_id, line, ordinal, mark) -> the most severe mark of each line; of equal ones the first."""
    severity = F.array_position(F.array(*map(F.lit, MARKS)), F.col("mark"))
    return marks.groupBy("citation_id", "line").agg(F.min_by("mark", F.struct(severity, "ordinal")).alias("mark"))
