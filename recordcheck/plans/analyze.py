"""The whole run over many files: parse, look up, match, select, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordcheck.config import Settings
from recordcheck.functions.identifiers import doi_key
from recordcheck.functions.text import normalized
from recordcheck.operators.candidates import build_candidates, select_candidate
from recordcheck.operators.checks import doi_checks
from recordcheck.operators.citations import build_citations
from recordcheck.operators.evaluate import evaluate
from recordcheck.operators.score import scored, work_keys
from recordcheck.schema import CHECK, WORK
from recordcheck.sources import bibtex
from recordcheck.sources.context import Context, items_in_context, parents_in_context
from recordcheck.sources.lookups import Source, is_strong, lookup_arxiv, lookup_doi, related_works, resolve_dois
from recordcheck.sources.tiers import search_tiers, with_strength
from recordcheck.storage import stored


@dataclass(frozen=True)
class Sources:
    """The sources of a run. `arxiv` is (arxiv_id, status, work), `resolver` (doi_key, status, target)."""

    crossref: Source
    datacite: Source
    dblp: Source
    openalex: Source
    arxiv: DataFrame
    resolver: DataFrame


@dataclass(frozen=True)
class Analysis:
    """Tables of one run, all keyed by citation_id."""

    citations: DataFrame
    statuses: DataFrame
    records: DataFrame
    candidates: DataFrame
    selection: DataFrame
    evaluated: DataFrame


def _judged(records: DataFrame, cited: DataFrame) -> DataFrame:
    """Records with whether they are strong matches of their citation."""
    rows = scored(work_keys(records).join(cited.select("citation_id", "a", "cut"), "citation_id"), "a", "k", "cut")
    return rows.withColumn("strong", is_strong(F.col("score.total"), F.col("score.contradictions"))).drop("a", "k", "cut", "score")


def analyze(files: DataFrame, sources: Sources, settings: Settings = Settings(), url_checks: DataFrame | None = None, context: Context | None = None) -> Analysis:
    """files (file_id, text) -> Analysis. With a context, entries take macros and parents' fields from the list they were chosen from.

    Searches are tiered: a source is asked for those citations only that still need it. Each tier's answers are written to the
    shared folder, as later tiers look at them: plans stay short, and nothing is searched twice.
    """
    parsed = stored(bibtex.items(files), "items")
    if context is None:
        citations = stored(build_citations(bibtex.entries(parsed), bibtex.fields(parsed)), "citations")
    else:
        parsed = stored(items_in_context(parsed, context), "items-in-context")
        citations = stored(build_citations(bibtex.entries(parsed), bibtex.fields(parsed), parents_in_context(parsed, context)), "citations")
    cited = stored(work_keys(citations.select("citation_id", F.col("work").alias("cited"), F.col("authors_truncated").alias("cut")), "cited", "a"), "cited")
    none_work = F.lit(None).cast(WORK)

    # ---- identifiers ----
    by_doi = citations.filter("coalesce(raw_doi, '') <> ''").select("citation_id", "raw_doi", doi_key("raw_doi").alias("doi_key"))
    wanted = by_doi.filter("doi_key IS NOT NULL").select("citation_id", "doi_key")
    resolved = resolve_dois(wanted, sources.resolver)
    answers = stored(lookup_doi(wanted, sources.crossref, sources.datacite), "answers")
    papers = citations.filter("work.arxiv_id IS NOT NULL").select("citation_id", "work.arxiv_id")
    arxiv = stored(lookup_arxiv(papers, sources.arxiv), "arxiv")
    hops = related_works(arxiv.filter("status = 'OK'").select("citation_id", "work"), sources.crossref)
    found = lambda df, tier, place=0: df.filter("status = 'OK' AND work IS NOT NULL").select("citation_id", F.lit(tier).alias("tier"), F.lit(place).alias("nth"), "work")
    records = found(answers, 0).unionByName(found(arxiv, 1)).unionByName(hops.select("citation_id", F.lit(2).alias("tier"), "nth", "work"))
    statuses = [
        resolved.select("citation_id", F.lit("DOI resolver").alias("source"), F.col("resolved").alias("status")),
        answers.select("citation_id", F.lit("Crossref").alias("source"), F.col("s1").alias("status")),
        answers.filter("s2 IS NOT NULL").select("citation_id", F.lit("DataCite").alias("source"), F.col("s2").alias("status")),
        arxiv.select("citation_id", F.lit("arXiv").alias("source"), "status"),
    ]

    # ---- searches ----
    asked = citations.filter("coalesce(work.title, '') <> ''").select("citation_id", normalized("work.title").alias("norm_title"), "cites_preprint", F.col("raw_doi").isNull().alias("no_doi"))
    state = stored(_judged(records, cited), "records")

    start = with_strength(asked, state).withColumn("wants_published", F.col("cites_preprint") | F.col("strong_preprint"))
    plan = start.select("citation_id", "norm_title", "no_doi", "wants_published", (~F.col("strong") | F.col("wants_published")).alias("discover"), F.lit(settings.mode == "clean").alias("clean"))
    by_name = {"Crossref": sources.crossref, "DBLP": sources.dblp, "OpenAlex": sources.openalex, "DataCite": sources.datacite}
    tiered = search_tiers(stored(plan, "plan"), state, by_name, lambda got: _judged(got, cited))
    state = tiered.records
    statuses += tiered.statuses

    order = Window.partitionBy("citation_id").orderBy("tier", "nth")
    all_records = state.withColumn("pos", F.row_number().over(order) - 1).select("citation_id", "pos", "work")
    candidates = stored(build_candidates(citations, stored(all_records, "ordered")), "candidates")
    selection = stored(select_candidate(citations, candidates), "selection")

    # ---- DOI checks and evaluation ----
    checked = by_doi.join(resolved, "citation_id", "left").join(answers.select("citation_id", "status", "work", "source"), "citation_id", "left").join(cited.select("citation_id", "a", "cut"), "citation_id")
    checked = scored(work_keys(checked.withColumn("work", F.coalesce("work", none_work))), "a", "k", "cut")
    checks = checked.select("citation_id", doi_checks(F.col("raw_doi"), F.col("resolved"), F.col("target"), F.col("status"), F.col("source"), F.col("score"), F.col("work.title")).alias("doi_checks"))
    chosen = selection.join(candidates, (selection["citation_id"] == candidates["citation_id"]) & (selection["selected"] == candidates["place"])).select(selection["citation_id"], F.struct("work", "records", "score").alias("cand"))
    empty = F.array().cast(f"array<{CHECK}>")
    ready = citations.join(chosen, "citation_id", "left").join(checks, "citation_id", "left").withColumn("doi_checks", F.coalesce("doi_checks", empty))
    if url_checks is None:
        ready = ready.withColumn("url_check", F.lit(None).cast("struct<state:string,label:string,detail:string,final_url:string,page_title:string>"))
    else:
        ready = ready.join(url_checks.select("citation_id", F.struct("state", "label", "detail", "final_url", "page_title").alias("url_check")), "citation_id", "left")
    evaluated = stored(evaluate(stored(ready, "ready"), settings, citations.select("file_id", "key")), "evaluated")
    log = statuses[0]
    for s in statuses[1:]:
        log = log.unionByName(s)
    return Analysis(citations, log, all_records, candidates, selection, evaluated)
