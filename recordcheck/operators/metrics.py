"""How suggestions compare with verified truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordcheck.config import CALIBRATION_THRESHOLDS
from recordcheck.functions.identifiers import doi_key, pages_equivalent
from recordcheck.functions.text import normalized
from recordcheck.functions.venue import venue_keys, venue_similarity


def judge(suggestions: DataFrame, truth: DataFrame) -> DataFrame:
    """suggestions (entry_id, field, category, kind, suggested), truth (entry_id, doi, doi_known, title, year, venue, pages) ->
    with verdict: correct, incorrect or unjudged.

    doi_known without a doi says that the work has none, so that any suggested one is wrong.
    """
    t = truth.select("entry_id", *[F.col(c).alias(f"t_{c}") for c in ("doi", "doi_known", "title", "year", "venue", "pages")])
    rows = suggestions.join(t, "entry_id", "left").withColumns({"__a": normalized("suggested"), "__b": normalized("t_title"), "__v": venue_keys("suggested"), "__w": venue_keys("t_venue")})
    field = F.lower("field")
    right = (
        F.when((field == "doi") & F.coalesce("t_doi_known", F.lit(False)), F.coalesce(doi_key("suggested") == doi_key("t_doi"), F.lit(False)))
        .when((field == "year") & F.col("t_year").isNotNull(), F.coalesce(F.col("suggested").cast("double") == F.col("t_year"), F.lit(False)))
        .when((field == "title") & (F.coalesce("t_title", F.lit("")) != ""), F.col("__a") == F.col("__b"))
        .when((field == "pages") & (F.coalesce("t_pages", F.lit("")) != ""), pages_equivalent("suggested", "t_pages"))
        .when(field.isin("journal", "booktitle") & (F.coalesce("t_venue", F.lit("")) != ""), venue_similarity(F.col("__v"), F.col("__w")) >= 0.85)
    )
    counts = F.col("category").isin("conflict", "missing", "version", "url") & (F.col("kind") == "set")
    verdict = F.when(~counts | right.isNull(), "unjudged").when(right, "correct").otherwise("incorrect")
    return rows.withColumn("verdict", verdict).drop("__a", "__b", "__v", "__w", *[c for c in t.columns if c != "entry_id"])


def top1_correct(chosen_doi: Column, chosen_norm_title: Column, chosen_year: Column, has_candidate: Column, truth: Column, truth_norm_title: Column) -> Column:
    """Whether the selected candidate is right; null where the truth doesn't say. truth is a struct as in judge, with ambiguous."""
    titled = F.coalesce(truth["title"], F.lit("")) != ""
    identified = F.coalesce(truth["doi"], F.lit("")) != ""
    return (
        F.when(F.coalesce(truth["ambiguous"], F.lit(False)), F.lit(None).cast("boolean"))
        .when(~has_candidate, F.when(F.coalesce(truth["doi_known"], F.lit(False)) | titled, False))
        .when(identified, F.coalesce(doi_key(chosen_doi) == doi_key(truth["doi"]), F.lit(False)))
        .when(titled, (F.coalesce(chosen_norm_title, F.lit("")) == truth_norm_title) & (truth["year"].isNull() | F.coalesce(chosen_year == truth["year"], F.lit(False))))
    )


def ratio(part: Column, whole: Column) -> Column:
    """Null where there is nothing to take a share of."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def report(outcomes: DataFrame, judged: DataFrame) -> DataFrame:
    """One row of metrics.

    outcomes: (entry_id, input_had_doi, doi, doi_known, ambiguous, ambiguous_predicted, top1, error), judged: (entry_id, field,
    confidence, verdict). Entries with an error count only as such.
    """
    fine = outcomes.filter("error IS NULL")
    j = judged.filter("verdict <> 'unjudged'").join(fine.select("entry_id", "input_had_doi"), "entry_id")
    doi, good = F.lower("field") == "doi", F.col("verdict") == "correct"
    high = F.col("confidence").isin("HIGH", "VERY HIGH")
    fresh = doi & ~F.col("input_had_doi")
    c = F.count_if
    marks = j.agg(
        c(fresh & good).alias("doi_right"), c(fresh).alias("doi_made"), c(doi & ~good).alias("doi_wrong"), c(doi).alias("doi_all"), c(good).alias("right"), F.count("*").alias("judged"),
        c(high & ~good).alias("high_wrong"), c(high).alias("high"),
    )
    found = j.filter(doi & good).select("entry_id").distinct().withColumn("found", F.lit(True))
    wanted = ~F.col("input_had_doi") & F.col("doi").isNotNull()
    entries = fine.join(found, "entry_id", "left").agg(
        F.count("*").alias("entries"), c(wanted).alias("doi_wanted"), c(wanted & F.coalesce("found", F.lit(False))).alias("doi_found"), c("top1").alias("top1_right"), F.count("top1").alias("top1_all"),
        c(F.col("ambiguous") == F.col("ambiguous_predicted")).alias("ambiguous_right"), F.count("ambiguous").alias("ambiguous_all"),
    )
    errors = outcomes.agg(c(F.col("error").isNotNull()).alias("errors"))
    one = entries.join(marks, how="cross").join(errors, how="cross")  # three tables of one row each
    share = lambda a, b, name: ratio(F.col(a), F.col(b)).alias(name)
    return one.select(
        "entries", "errors", share("doi_right", "doi_made", "doi_precision"), share("doi_found", "doi_wanted", "doi_recall"), share("doi_wrong", "doi_all", "incorrect_doi_rate"),
        share("right", "judged", "field_precision"), share("top1_right", "top1_all", "top1_accuracy"), share("ambiguous_right", "ambiguous_all", "ambiguity_accuracy"),
        share("high_wrong", "high", "high_confidence_incorrect_rate"), (F.col("high_wrong") == 0).alias("release"),
    )


def calibration(outcomes: DataFrame) -> DataFrame:
    """(threshold, n, precision): of entries at or above a score, the share whose selected candidate is right.

    Each row counts once for every threshold it reaches, by partial aggregation; thresholds no entry reaches have n = 0.
    """
    spark: SparkSession = outcomes.sparkSession
    levels = F.array(*[F.lit(t) for t in CALIBRATION_THRESHOLDS])
    rows = outcomes.filter("top1 IS NOT NULL AND score IS NOT NULL").select("top1", F.explode(F.filter(levels, lambda t: F.col("score") >= t)).alias("threshold"))
    sums = rows.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if("top1").alias("right"))
    every = spark.createDataFrame([(t,) for t in CALIBRATION_THRESHOLDS], "threshold double")
    joined = every.join(F.broadcast(sums), "threshold", "left")  # six rows at most
    return joined.select("threshold", F.coalesce("n", F.lit(0)).alias("n"), ratio(F.col("right"), F.col("n")).alias("precision"))


def wrong_with_high_confidence(judged: DataFrame) -> DataFrame:
    """What must be empty before a release."""
    return judged.filter("verdict = 'incorrect' AND confidence IN ('HIGH', 'VERY HIGH')").select("entry_id", "field", "suggested")
