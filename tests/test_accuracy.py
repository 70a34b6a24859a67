"""A small corpus with known truth, read from a file and measured in one run."""

import json

from pyspark.sql import functions as F
from test_scenarios import ATOM, CROSSREF, ENTRIES

from recordcheck.plans.accuracy import measure, read_corpus
from recordcheck.plans.analyze import Sources
from recordcheck.sources.lookups import SnapshotSource, with_norm_title
from recordcheck.sources.payloads import map_arxiv, map_crossref
from recordcheck.storage import stored

TRUTH = {
    "wrong_doi": {"doi": "10.5555/graph", "title": "Graph Sketching at Planetary Scale", "year": 2020},
    "twins": {"title": "On the Nature of Things", "ambiguous": True},
    "no_doi": {"doi": None, "title": "Perfectly Ordinary Result", "year": 2019},
    "broken": {"title": "never closed"},
}


def test_a_corpus_is_read_and_measured(spark, tmp_path):
    entries = [{"id": k, "bib": ENTRIES[k], "truth": t} for k, t in TRUTH.items()] + [{"id": "form", "bib": "@misc{x}", "truth": {}, "_template": True}]
    (tmp_path / "corpus.json").write_text(json.dumps(entries))
    (tmp_path / "other.json").write_text("no list")
    corpus = stored(read_corpus(spark, str(tmp_path)), "test-corpus")
    assert {r["entry_id"]: r["doi_known"] for r in corpus.collect()} == {"wrong_doi": True, "twins": False, "no_doi": True, "broken": False}

    works = spark.createDataFrame([(json.dumps(p),) for p in CROSSREF], "p string").select(map_crossref("p").alias("work"))
    answers = works.filter("work.doi IS NOT NULL").select(F.lower("work.doi").alias("doi_key"), F.lit("OK").alias("status"), "work")
    source = lambda name, w, a: SnapshotSource(name, a, with_norm_title(w), name != "DBLP")
    none, no_answers = works.filter("false"), answers.filter("false")
    arxiv = spark.createDataFrame([("2301.00001", "OK", ATOM)], "arxiv_id string, status string, p string").select("arxiv_id", "status", map_arxiv("p").alias("work"))
    resolver = spark.createDataFrame([("10.5555/bees", "OK", "http://bees")], "doi_key string, status string, target string")
    got = measure(corpus, Sources(source("Crossref", works, answers), source("DataCite", none, no_answers), source("DBLP", none, no_answers), source("OpenAlex", none, no_answers), arxiv, resolver))
    outcomes = {r["entry_id"]: (r["top1"], r["ambiguous_predicted"], r["error"] is None) for r in got.outcomes.collect()}
    assert outcomes["wrong_doi"] == (True, False, True) and outcomes["no_doi"][0] is True and outcomes["twins"] == (None, True, True) and outcomes["broken"][2] is False
    verdicts = {(r["entry_id"], r["field"]): r["verdict"] for r in got.judged.collect()}
    assert verdicts["wrong_doi", "doi"] == "correct" and ("no_doi", "doi") not in verdicts
    assert got.metrics.count() == 1 and got.blockers.count() == 0
