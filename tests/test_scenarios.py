"""Citations that are wrong in ways that matter, all in one run."""

import json

import pytest
from pyspark.sql import functions as F

from recordcheck.operators.evaluate import check_rows, suggestion_rows
from recordcheck.plans.analyze import Sources, analyze
from recordcheck.sources.bibtex import items
from recordcheck.sources.context import Context
from recordcheck.sources.lookups import SnapshotSource, with_norm_title
from recordcheck.sources.payloads import map_arxiv, map_crossref

ENTRIES = {
    "wrong_doi": "@article{a, title={Graph Sketching at Planetary Scale}, author={Ann Lee and Bo Chen}, journal={Journal of Graphs}, year=2020, doi={10.5555/bees}}",
    "dead_doi": "@article{b, title={A Paper That Nobody Indexed Yet}, author={Cy Dent}, journal={J}, year=2020, doi={10.5555/dead}}",
    "preprint": "@misc{c, title={Sparse Attention Without Tears}, author={Dee Moss}, year=2023, eprint={2301.00001}, archiveprefix={arXiv}}",
    "twins": "@misc{d, title={On the Nature of Things}}",
    "notice": "@article{e, title={Robust Parsing of Broken Files}, author={Eve Ray}, journal={Journal of Files}, year=2021}",
    "no_doi": "@article{f, title={Perfectly Ordinary Result}, author={Fay Sun}, journal={Journal of Results}, year=2019}",
    "broken": "@article{g, title={never closed",
    "listed": "@inproceedings{h, title={Walking Through Long Lists}, author=hay, crossref={P}}",
}
#: The list that the last entry was chosen from.
LIST = "@string{hay = {Hal Hay}}\n@proceedings{p, title={Days of Lists}, year=2018, publisher=pub}\n@string{pub = {List Press}}\n@misc{h, title={another}}"


def record(doi, title, authors, year, venue, **more):
    people = [{"family": a.split()[-1], "given": " ".join(a.split()[:-1])} for a in authors]
    return {"DOI": doi, "title": [title], "author": people, "issued": {"date-parts": [[year]]}, "container-title": [venue], "type": "journal-article"} | more


CROSSREF = [
    record("10.5555/graph", "Graph Sketching at Planetary Scale", ["Ann Lee", "Bo Chen"], 2020, "Journal of Graphs"),
    record("10.5555/bees", "Foraging Strategies of Solitary Bees", ["Zoe Hive"], 2011, "Journal of Bees"),
    record("10.5555/sparse", "Sparse Attention Without Tears", ["Dee Moss"], 2024, "Journal of Attention", volume="9", page="1-12"),
    record("10.5555/nature1", "On the Nature of Things", ["Ida Kay"], 2001, "Journal of Things"),
    record("10.5555/nature2", "On the Nature of Things", ["Jon Low"], 2015, "Things Review"),
    record("10.5555/erratum", "Erratum: Robust Parsing of Broken Files", ["Eve Ray"], 2021, "Journal of Files"),
    record("10.5555/lists", "Walking Through Long Lists", ["Hal Hay"], 2018, "Days of Lists", type="proceedings-article", publisher="List Press"),
    {k: v for k, v in record("", "Perfectly Ordinary Result", ["Fay Sun"], 2019, "Journal of Results").items() if k != "DOI"},
]
ATOM = "<feed><entry><id>http://arxiv.org/abs/2301.00001v1</id><title>Sparse Attention Without Tears</title><published>2023-01-01</published><author><name>Dee Moss</name></author><arxiv:doi>10.5555/sparse</arxiv:doi></entry></feed>"


@pytest.fixture(scope="module")
def run(spark):
    works = spark.createDataFrame([(json.dumps(p),) for p in CROSSREF], "p string").select(map_crossref("p").alias("work"))
    answers = works.filter("work.doi IS NOT NULL").select(F.lower("work.doi").alias("doi_key"), F.lit("OK").alias("status"), "work")
    source = lambda name, w, a: SnapshotSource(name, a, with_norm_title(w), name != "DBLP")
    none, no_answers = works.filter("false"), answers.filter("false")
    arxiv = spark.createDataFrame([("2301.00001", "OK", ATOM)], "arxiv_id string, status string, p string").select("arxiv_id", "status", map_arxiv("p").alias("work"))
    resolver = spark.createDataFrame([("10.5555/bees", "OK", "http://bees")], "doi_key string, status string, target string")
    sources = Sources(source("Crossref", works, answers), source("DataCite", none, no_answers), source("DBLP", none, no_answers), source("OpenAlex", none, no_answers), arxiv, resolver)
    context = Context(items(spark.createDataFrame([("list", LIST)], "file_id string, text string")), spark.createDataFrame([("listed", "list")], "file_id string, library string"))
    got = analyze(spark.createDataFrame(list(ENTRIES.items()), "file_id string, text string"), sources, context=context)
    name = lambda r: r["citation_id"].split(":")[0]
    checks, suggestions = {}, {}
    for r in check_rows(got.evaluated).collect():
        checks.setdefault(name(r), {})[r["id"]] = r["state"]
    for r in suggestion_rows(got.evaluated).collect():
        suggestions.setdefault(name(r), []).append(r)
    candidates = {}
    for r in got.candidates.select("citation_id", "place", "work.doi", "work.title", "score.state", "version_group").collect():
        candidates.setdefault(name(r), {})[r["place"]] = r
    cited = {name(r): r for r in got.citations.filter("file_id = 'listed'").select("citation_id", "work.venue", "work.year", "work.publisher", "work.authors", "inherited").collect()}
    return {name(r): r for r in got.selection.collect()}, checks, suggestions, candidates | {"cited": cited}


def sure(rows):
    return [(r["field"], r["value"]) for r in rows if r["confidence"] in ("HIGH", "VERY HIGH") and r["category"] not in ("format", "key")]


def test_a_doi_of_another_work_is_replaced(run):
    selection, checks, suggestions, candidates = run
    assert checks["wrong_doi"]["doi-identity"] == "CONFLICT" and checks["wrong_doi"]["doi-resolve"] == "VERIFIED"
    assert candidates["wrong_doi"][selection["wrong_doi"]["selected"]]["doi"] == "10.5555/graph"
    doi = [r for r in suggestions["wrong_doi"] if r["field"] == "doi"]
    assert [(r["operation"], r["category"], r["value"]) for r in doi] == [("replace", "conflict", "10.5555/graph")]
    assert not [r for r in suggestions["wrong_doi"] if r["field"] == "url"]  # no link from a DOI under suspicion


def test_a_doi_that_is_unknown(run):
    selection, checks, suggestions, _ = run
    assert selection["dead_doi"]["selected"] is None
    assert checks["dead_doi"] == {"doi-syntax": "VERIFIED", "doi-resolve": "CONFLICT", "doi-meta": "UNVERIFIED", "match": "UNVERIFIED"}
    assert not sure(suggestions["dead_doi"])


def test_a_preprint_has_a_published_version(run):
    selection, _, suggestions, candidates = run
    s = selection["preprint"]
    assert s["selected"] == s["published"] != s["preprint"] and candidates["preprint"][s["published"]]["doi"] == "10.5555/sparse"
    made = {r["field"]: r["category"] for r in suggestions["preprint"]}
    assert made["doi"] == made["volume"] == made["pages"] == made["journal"] == made["url"] == "version"


def test_twins_are_left_to_the_user(run):
    selection, checks, suggestions, candidates = run
    assert selection["twins"]["ambiguous"] and selection["twins"]["selected"] is None and len(candidates["twins"]) == 2
    assert checks["twins"]["match"] == "UNVERIFIED" and not sure(suggestions["twins"])


def test_a_notice_is_not_the_work(run):
    _, checks, suggestions, candidates = run
    assert candidates["notice"][0]["state"] == "CONFLICT" == checks["notice"]["match"]
    assert not sure(suggestions["notice"])


def test_no_doi_is_invented(run):
    selection, _, suggestions, _ = run
    assert selection["no_doi"]["selected"] == 0
    assert not [r for r in suggestions["no_doi"] if r["field"] in ("doi", "url")]


def test_an_entry_has_the_context_of_its_list(run):
    selection, _, suggestions, candidates = run
    cited = candidates["cited"]["listed"]
    assert (cited["venue"], cited["year"], cited["publisher"], cited["authors"][0]["family"]) == ("Days of Lists", 2018, "List Press", "Hay")
    assert cited["inherited"] == ["booktitle", "publisher", "year"]
    assert candidates["listed"][selection["listed"]["selected"]]["doi"] == "10.5555/lists"
    made = {r["field"]: r["category"] for r in suggestions["listed"]}
    assert made["doi"] == "missing" and not {"year", "booktitle", "publisher", "author"} & made.keys()


def test_nothing_is_accepted_by_itself(run):
    _, _, suggestions, _ = run
    assert all(r["accepted"] is None for rows in suggestions.values() for r in rows)
    assert "broken" not in suggestions
