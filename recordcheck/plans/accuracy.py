"""Accuracy of a run over a corpus of citations whose truth is known."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordcheck.config import Settings
from recordcheck.functions.text import normalized
from recordcheck.operators.evaluate import suggestion_rows
from recordcheck.operators.metrics import judge, report, top1_correct, wrong_with_high_confidence
from recordcheck.plans.analyze import Sources, analyze
from recordcheck.storage import stored

#: A corpus entry; `doi` null beside a true `doi_known` says that the work has none.
CORPUS = "id string, bib string, _template boolean, truth struct<doi:string,title:string,year:int,venue:string,pages:string,ambiguous:boolean>"


@dataclass(frozen=True)
class Accuracy:
    """Tables of a run: an outcome for each entry, judged suggestions, one row of metrics, and what must be empty before a release."""

    outcomes: DataFrame
    judged: DataFrame
    metrics: DataFrame
    blockers: DataFrame


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold a JSON list of entries -> (entry_id, bib, doi, doi_known, title, year, venue, pages, ambiguous).

    Entries that are marked as templates are left out. A null truth doi counts as known, an absent one doesn't. A file that
    is no JSON list gives no rows.
    """
    entry = F.from_json("value", CORPUS)
    texts = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    known = F.array_contains(F.json_object_keys(F.get_json_object("value", "$.truth")), "doi")
    rows = texts.select(entry.alias("e"), F.coalesce(known, F.lit(False)).alias("doi_known")).filter("e.id IS NOT NULL AND e.bib IS NOT NULL AND NOT coalesce(e._template, false)")
    return rows.select(F.col("e.id").alias("entry_id"), "e.bib", "doi_known", "e.truth.doi", "e.truth.title", "e.truth.year", "e.truth.venue", "e.truth.pages", F.coalesce("e.truth.ambiguous", F.lit(False)).alias("ambiguous"))


def measure(corpus: DataFrame, sources: Sources, settings: Settings = Settings()) -> Accuracy:
    """Analyse each entry of a stored corpus and hold what is chosen and suggested against its truth.

    An entry whose text gives no citation counts as an error and nothing else. Of several citations in one text the first
    counts. An empty corpus gives empty tables and a row of metrics without shares.
    """
    run = analyze(corpus.select(F.col("entry_id").alias("file_id"), F.col("bib").alias("text")), sources, settings)
    first = run.citations.groupBy("file_id").agg(F.min_by(F.struct("citation_id", "raw_doi"), "pos").alias("c")).select(F.col("file_id").alias("entry_id"), "c.citation_id", F.col("c.raw_doi").isNotNull().alias("input_had_doi"))
    chosen = run.selection.select("citation_id", "selected", "ambiguous").join(
        run.candidates.select("citation_id", F.col("place").alias("selected"), "work", F.lit(True).alias("found")), ["citation_id", "selected"], "left"
    )
    rows = corpus.join(first, "entry_id", "left").join(chosen.withColumnRenamed("ambiguous", "ambiguous_predicted"), "citation_id", "left")
    truth = F.struct("doi", "doi_known", "title", "year", "ambiguous")
    right = top1_correct(F.col("work.doi"), F.col("chosen_title"), F.col("work.year"), F.coalesce("found", F.lit(False)), truth, F.col("true_title"))
    rows = rows.withColumns({"chosen_title": normalized("work.title"), "true_title": normalized("title")}).withColumns({"top1": right, "error": F.when(F.col("citation_id").isNull(), "no citation could be read")})
    names = ["entry_id", "citation_id", "input_had_doi", "doi", "doi_known", "ambiguous", "ambiguous_predicted", "top1", "error"]
    outcomes = stored(rows.select(*names), "outcomes")
    made = suggestion_rows(run.evaluated).join(outcomes.select("citation_id", "entry_id"), "citation_id")
    judged = stored(judge(made, corpus), "judged")
    return Accuracy(outcomes, judged, report(outcomes, judged), wrong_with_high_confidence(judged))
