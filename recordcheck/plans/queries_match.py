"""Queries over payloads, lookups, scores and candidates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordcheck.config import FAILURES
from recordcheck.functions.text import normalized, title_similarity
from recordcheck.operators.candidates import build_candidates, first_fit_rows, group_records, merge_records, select_candidate
from recordcheck.operators.checks import doi_checks
from recordcheck.operators.prefixes import prefix_pairs
from recordcheck.operators.score import WRONG_DOI, confidence_for, rounded, weighted_score, year_score
from recordcheck.plans.registry import letters, query, table, text
from recordcheck.schema import WORK, WORK_FIELDS
from recordcheck.sources import payloads
from recordcheck.sources.answers import AnswersLookup, write_answers
from recordcheck.sources.bibtex import fields, items
from recordcheck.sources.cache import lifetime, paced_starts, replay_cache
from recordcheck.sources.lookups import SnapshotSource, json_status, lookup_arxiv, lookup_doi, related_works, resolve_dois, resolver_status, search_titles, unavailable, with_norm_title
from recordcheck.sources.retries import ask_again, recorded
from recordcheck.sources.tiers import search_tiers
from recordcheck.storage import shared_folder, stored


def work(**values: Column) -> Column:
    given = {"authors": F.array(), "related_dois": F.array(), "is_preprint": F.lit(False)} | values
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in WORK_FIELDS]).cast(WORK)


def from_source(name: str) -> Column:
    return F.array(F.struct(F.lit(name).alias("source"), F.lit(None).alias("record_url"), F.lit(None).alias("native_id"), F.lit(None).alias("retrieved_at")))


def person(family: Column, given: str | Column) -> Column:
    return F.struct(family.alias("family"), (F.lit(given) if isinstance(given, str) else given).alias("given"), F.lit(None).cast("string").alias("literal"))


# ---- payloads ----
_FIELDS = ("title", "year", "venue", "publisher", "pages", "doi", "type", "is_preprint")


def _mapped(rows, source: str, payload: Column):
    w = payloads.with_work(rows.select("p_partkey", payload.alias("payload")), source, F.col("payload"), work="w")
    names = F.array_join(F.transform("w.authors", lambda a: F.concat_ws("|", a["family"], a["given"], a["literal"])), ";")
    return w.select("p_partkey", *[F.coalesce(F.col(f"w.{f}").cast("string"), F.lit("-")).alias(f) for f in _FIELDS], names.alias("names"), F.array_join("w.related_dois", ",").alias("related"))


def _json_object(**fields) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


@query(
    """SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ': ' || p_type ELSE '' END AS title, (1950 + p_size)::VARCHAR AS year, 'J & ' || p_brand AS venue, p_brand AS publisher, '1-9' AS pages, '10.5555/C' || p_partkey AS doi,
    CASE WHEN p_partkey % 3 = 0 THEN 'preprint' ELSE 'article' END AS type, CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'false' END AS is_preprint, 'Doe|Jo;Org||Org' AS names, '10.5555/v' || p_partkey AS related FROM part"""
)
def map_crossref(spark, sf_dir):
    name, key = F.col("p_name"), F.col("p_partkey")
    parts = lambda y: F.struct(F.array(F.array(y, F.lit(5))).alias("date-parts"))
    subtitle = F.when(key % 2 == 0, F.array("p_type")).otherwise(F.array(F.split("p_name", " ")[0]))
    relation = F.struct(F.array(F.struct(text("https://doi.org/10.5555/v", key).alias("id"), F.lit("doi").alias("id-type")), F.struct(F.lit("x").alias("id"), F.lit("uri").alias("id-type"))).alias("has-preprint"))
    author = F.array(F.struct(F.lit("Doe").alias("family"), F.lit("Jo").alias("given"), F.lit(None).cast("string").alias("name")), F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given"), F.lit("Org").alias("name")))
    dated = {"issued": F.when(key % 2 == 0, parts(F.col("p_size") + 1950)), "published-print": parts(F.col("p_size") + 1950)}
    payload = _json_object(
        DOI=text("10.5555/C", key), title=F.array(text("<i>", name, "</i>")), subtitle=subtitle, author=author, **dated, **{"container-title": F.array(text("J &amp; ", F.col("p_brand")))}, publisher=F.col("p_brand"), page="1-9",
        type=F.when(key % 3 == 0, "posted-content").otherwise("journal-article"), relation=relation,
    )
    return _mapped(table(spark, sf_dir, "part"), "Crossref", payload)


@query(
    """SELECT p_partkey, p_name AS title, (1950 + p_size)::VARCHAR AS year, CASE WHEN p_partkey % 2 = 0 THEN 'arXiv' ELSE p_type END AS venue, p_brand AS publisher, '3--8' AS pages, CASE WHEN p_partkey % 2 = 0 THEN '10.48550/arXiv.2401.' || p_partkey ELSE '10.5555/d' || p_partkey END AS doi,
    CASE WHEN p_partkey % 2 = 0 THEN 'preprint' ELSE 'dataset' END AS type, CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS is_preprint, 'Doe|Jo;Roe|Al;Org||Org' AS names, '10.5555/v' || p_partkey AS related FROM part"""
)
def map_datacite(spark, sf_dir):
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    creator = lambda name, kind=none, family=none, given=none: F.struct(F.lit(name).alias("name"), kind.alias("nameType"), family.alias("familyName"), given.alias("givenName"))
    creators = F.array(creator("x", none, F.lit("Doe"), F.lit("Jo")), creator("Roe, Al"), creator("Org", F.lit("Organizational")))
    related = F.array(F.struct(text("10.5555/v", key).alias("relatedIdentifier"), F.lit("DOI").alias("relatedIdentifierType"), F.lit("IsVersionOf").alias("relationType")), F.struct(F.lit("10.5555/q").alias("relatedIdentifier"), F.lit("DOI").alias("relatedIdentifierType"), F.lit("Cites").alias("relationType")))
    box = F.struct(F.col("p_type").alias("title"), F.lit("3").alias("firstPage"), F.lit("8").alias("lastPage"))
    doi = F.when(key % 2 == 0, text("10.48550/arXiv.2401.", key)).otherwise(text("10.5555/d", key))
    attributes = dict(doi=doi, titles=F.array(F.struct(F.col("p_name").alias("title"))), creators=creators, publicationYear=F.col("p_size") + 1950, container=box, types=F.struct(F.lit("Dataset").alias("resourceTypeGeneral")), relatedIdentifiers=related)
    plain = F.struct(*[c.alias(n) for n, c in attributes.items()], F.col("p_brand").alias("publisher"))
    nested = F.struct(*[c.alias(n) for n, c in attributes.items()], F.struct(F.col("p_brand").alias("name")).alias("publisher"))
    payload = F.when(key % 3 == 0, F.to_json(F.struct(plain.alias("attributes")))).otherwise(F.to_json(F.struct(nested.alias("attributes"))))
    return _mapped(table(spark, sf_dir, "part"), "DataCite", payload)


@query(
    """SELECT p_partkey, p_name AS title, (1950 + p_size)::VARCHAR AS year, CASE WHEN p_partkey % 2 = 0 THEN 'CoRR' ELSE p_brand END AS venue, '-' AS publisher, '1-2' AS pages, CASE WHEN p_partkey % 3 = 0 THEN '10.5555/b' || p_partkey ELSE '-' END AS doi,
    CASE WHEN p_partkey % 2 = 0 THEN 'preprint' ELSE 'article' END AS type, CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS is_preprint, CASE WHEN p_partkey % 2 = 0 THEN 'de la Cruz|Jo' ELSE 'Doe|Jo;Roe|Al' END AS names, '' AS related FROM part"""
)
def map_dblp(spark, sf_dir):
    """Values that are scalars in some records and lists in others."""
    key = F.col("p_partkey")
    common = dict(title=text(F.col("p_name"), "."), year=F.col("p_size").cast("int") + 1950, pages="1-2", type="Journal Articles", key=text("k/", key), doi=F.when(key % 3 == 0, text("10.5555/b", key)))
    one = _json_object(**common, venue="CoRR", volume=text("abs/2401.", key), authors=F.struct(F.struct(F.lit("Jo de la Cruz 0003").alias("text")).alias("author")), ee=F.array(F.lit("https://arxiv.org/abs/1")))
    many = _json_object(**common, venue=F.array("p_brand", F.lit("x")), authors=F.struct(F.array(F.struct(F.lit("Jo Doe").alias("text")), F.struct(F.lit("Al Roe").alias("text"))).alias("author")), ee="https://x.org")
    return _mapped(table(spark, sf_dir, "part"), "DBLP", F.when(key % 2 == 0, one).otherwise(many))


@query(
    """SELECT p_partkey, p_name AS title, (1950 + p_size)::VARCHAR AS year, p_type AS venue, p_brand AS publisher, CASE WHEN p_partkey % 2 = 0 THEN '4--9' ELSE '4' END AS pages, '10.5555/o' || p_partkey AS doi,
    CASE WHEN p_partkey % 3 = 0 THEN 'inproceedings' ELSE 'article' END AS type, 'false' AS is_preprint, 'Doe|Jo B.;Roe|' AS names, '' AS related FROM part"""
)
def map_openalex(spark, sf_dir):
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    place = F.struct(F.col("p_type").alias("display_name"), F.when(key % 3 == 0, "conference").otherwise("journal").alias("type"), F.col("p_brand").alias("host_organization_name"))
    people = F.array(F.struct(F.struct(F.lit("Jo B. Doe").alias("display_name")).alias("author"), none.alias("raw_author_name")), F.struct(F.struct(none.alias("display_name")).alias("author"), F.lit("Roe").alias("raw_author_name")))
    biblio = F.struct(F.lit("4").alias("first_page"), F.when(key % 2 == 0, "9").otherwise("4").alias("last_page"))
    payload = _json_object(id="W", doi=text("https://doi.org/10.5555/o", key), display_name=F.col("p_name"), publication_year=F.col("p_size") + 1950, type="article", authorships=people, primary_location=F.struct(place.alias("source")), biblio=biblio)
    return _mapped(table(spark, sf_dir, "part"), "OpenAlex", payload)


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE p_name || ' & x' END AS title, CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE (1950 + p_size)::VARCHAR END AS year, CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE 'arXiv' END AS venue, '-' AS publisher, '-' AS pages,
    CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE '10.48550/arXiv.2401.' || lpad(p_partkey::VARCHAR, 5, '0') END AS doi, CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE 'preprint' END AS type, CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE 'true' END AS is_preprint,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'van Dam|Jo;Roe|Al' END AS names, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE '10.5555/pub' || p_partkey END AS related FROM part"""
)
def map_arxiv(spark, sf_dir):
    """Feeds, of which every fifth is an error message."""
    key = F.col("p_partkey")
    number = F.lpad(key.cast("string"), 5, "0")
    title = F.when(key % 5 == 0, "Error").otherwise(text(F.col("p_name"), " &amp;\n  x"))
    feed = text(
        "<feed><title>query</title><entry>\n<id>http://arxiv.org/abs/2401.", number, "v2</id><published>", F.col("p_size") + 1950, "-01-01</published><title>", title,
        '</title><author>\n<name>Jo van Dam</name></author><author><name>Al Roe</name></author><arxiv:doi xmlns:arxiv="u">10.5555/pub', key, "</arxiv:doi></entry><entry><title>other</title></entry></feed>",
    )
    return _mapped(table(spark, sf_dir, "part"), "arXiv", feed)


# ---- lookups ----
def _answers(spark, sf_dir: str, source: str, keep: Column, status: Column | str = "OK"):
    rows = table(spark, sf_dir, "part").filter(keep)
    state = F.lit(status) if isinstance(status, str) else status
    w = work(title=text(F.col("p_name"), f" {source}"), doi=text("10.5555/", F.col("p_partkey")), sources=from_source(source), related_dois=F.array(text("10.5555/", F.col("p_partkey") + 1)))
    return rows.select(text("10.5555/", F.col("p_partkey")).alias("doi_key"), state.alias("status"), w.alias("work"))


def _wanted(spark, sf_dir: str):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("citation_id"), text("10.5555/", F.col("p_partkey")).alias("doi_key"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 10 > 0 THEN 'OK' WHEN p_partkey % 3 = 0 THEN 'OK' WHEN p_partkey % 10 = 0 THEN 'RATE LIMITED' ELSE 'NO RECORD FOUND' END AS status,
    CASE WHEN p_partkey % 2 = 0 AND p_partkey % 10 > 0 THEN 'Crossref' WHEN p_partkey % 3 = 0 THEN 'DataCite' END AS source, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 10 > 0 THEN p_name || ' Crossref' WHEN p_partkey % 3 = 0 THEN p_name || ' DataCite' END AS title FROM part"""
)
def lookup_fallback(spark, sf_dir):
    """Crossref knows even keys but refuses every tenth; DataCite knows multiples of three."""
    key = F.col("p_partkey")
    one = _answers(spark, sf_dir, "Crossref", key % 2 == 0, F.when(key % 10 == 0, "RATE LIMITED").otherwise("OK"))
    two = _answers(spark, sf_dir, "DataCite", key % 3 == 0)
    found = lookup_doi(_wanted(spark, sf_dir), SnapshotSource("Crossref", one, one), SnapshotSource("DataCite", two, two))
    return found.select(F.col("citation_id").alias("p_partkey"), "status", "source", "work.title")


@query(
    """WITH a AS (SELECT *, p_partkey % 2 = 0 AND p_partkey % 10 > 0 AND p_partkey % 14 > 0 AS one, p_partkey % 3 = 0 AS two FROM part)
    SELECT p_partkey, CASE WHEN one OR two THEN 'OK' WHEN p_partkey % 10 = 0 THEN 'RATE LIMITED' WHEN p_partkey % 14 = 0 THEN 'LOOKUP FAILED' ELSE 'NO RECORD FOUND' END AS status,
    CASE WHEN one THEN 'Crossref' WHEN two THEN 'DataCite' END AS source, CASE WHEN one THEN p_name || ' at Crossref' WHEN two THEN p_name || ' at DataCite' END AS title FROM a"""
)
def answers_lookup(spark, sf_dir):
    """Services' answers are stored in buckets and read through the data source: Crossref refuses some keys and sends HTML for others."""
    key, folder = F.col("p_partkey"), f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    part = table(spark, sf_dir, "part")
    doi, title = text("10.5555/", key), lambda source: text(F.col("p_name"), f" at {source}")
    one = F.when(key % 14 == 0, "<html>busy</html>").otherwise(_json_object(DOI=doi, title=F.array(title("Crossref"))))
    two = F.to_json(F.struct(F.struct(doi.alias("doi"), F.array(F.struct(title("DataCite").alias("title"))).alias("titles")).alias("attributes")))
    made = part.filter(key % 2 == 0).select(F.lit("Crossref").alias("source"), doi.alias("key"), F.when(key % 10 == 0, 429).otherwise(200).alias("http"), one.alias("body"))
    write_answers(made.unionByName(part.filter(key % 3 == 0).select(F.lit("DataCite").alias("source"), doi.alias("key"), F.lit(200).alias("http"), two.alias("body"))), folder, 16)
    found = lookup_doi(_wanted(spark, sf_dir), *(AnswersLookup(spark, name, folder, buckets=16) for name in ("Crossref", "DataCite")))
    return found.select(F.col("citation_id").alias("p_partkey"), "status", "source", "work.title")


@query(
    """WITH n AS (SELECT DISTINCT p_name || ' of the ' || p_type AS a FROM part), w AS (SELECT p_partkey, p_name || ' of the ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN ' kind ' || p_size ELSE '' END AS b FROM part)
    SELECT a, p_partkey, b FROM n JOIN w ON starts_with(b, a) WHERE length(a) >= 20 UNION ALL SELECT a, p_partkey, b FROM n JOIN w ON starts_with(a, b) AND a <> b WHERE length(b) >= 20"""
)
def title_beginnings(spark, sf_dir):
    """Titles that begin with another title, or begin one."""
    part = table(spark, sf_dir, "part")
    head = text(F.col("p_name"), " of the ", F.col("p_type"))
    longer = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, text(head, " kind ", F.col("p_size"))).otherwise(head).alias("b"))
    pairs = prefix_pairs(part.select(head.alias("text")), longer.select(F.col("b").alias("text")), 20)
    return pairs.join(longer, "b").select("a", "p_partkey", "b")


@query("SELECT p_partkey, 'LOOKUP FAILED' AS status FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, 'OK' FROM part WHERE p_partkey % 3 = 0")
def lookup_unavailable(spark, sf_dir):
    """The first source is down: that is reported, unless the second has an answer."""
    two = _answers(spark, sf_dir, "DataCite", F.col("p_partkey") % 3 == 0)
    found = lookup_doi(_wanted(spark, sf_dir), SnapshotSource("Crossref", two, two, failing="LOOKUP FAILED"), SnapshotSource("DataCite", two, two))
    return found.select(F.col("citation_id").alias("p_partkey"), "status")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'NO RECORD FOUND' WHEN 2 THEN 'RATE LIMITED' ELSE 'NO RECORD FOUND' END AS resolved, CASE WHEN p_partkey % 4 = 0 THEN 'https://x.org/' || p_partkey END AS target,
    CASE p_partkey % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'NETWORK UNAVAILABLE' ELSE 'NO RECORD FOUND' END AS status, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' arXiv' END AS title FROM part"""
)
def lookup_identifiers(spark, sf_dir):
    """What the DOI resolver says, and arXiv records by numbers of any version; what could not be asked is no answer."""
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    doi, number = text("10.5555/", key), text(F.floor(key / 100000) + 2401, ".", F.lpad((key % 100000).cast("string"), 5, "0"))
    resolver = part.filter(key % 4 < 3).select(doi.alias("doi_key"), F.when(key % 4 == 0, "OK").when(key % 4 == 1, "NO RECORD FOUND").otherwise("RATE LIMITED").alias("status"), F.when(key % 4 == 0, text("https://x.org/", key)).alias("target"))
    answers = part.filter(key % 3 < 2).select(number.alias("arxiv_id"), F.when(key % 3 == 0, "OK").otherwise("NETWORK UNAVAILABLE").alias("status"), work(title=text(F.col("p_name"), " arXiv")).alias("work"))
    papers = part.select(key.alias("citation_id"), text(number, F.when(key % 2 == 0, "v2").otherwise("")).alias("arxiv_id"))
    found = resolve_dois(_wanted(spark, sf_dir), resolver).join(lookup_arxiv(papers, answers), "citation_id")
    return found.select(F.col("citation_id").alias("p_partkey"), "resolved", "target", "status", "work.title")


@query("SELECT a.p_partkey, b.p_name || ' Crossref' AS title FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE b.p_partkey % 2 = 0")
def related_doi_hop(spark, sf_dir):
    one = _answers(spark, sf_dir, "Crossref", F.col("p_partkey") % 2 == 0)
    all_ = _answers(spark, sf_dir, "arXiv", F.lit(True))
    records = _wanted(spark, sf_dir).join(all_, "doi_key").select("citation_id", "work")
    return related_works(records, SnapshotSource("Crossref", one, one)).select(F.col("citation_id").alias("p_partkey"), "work.title")


@query("SELECT user_id, string_agg(DISTINCT s, ',' ORDER BY s) AS unavailable FROM (SELECT user_id, 'S' || (event_id % 3) AS s, event_type FROM events) WHERE event_type IN ('error', 'view') GROUP BY user_id")
def unavailable_sources(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "error", FAILURES[0]).when(kind == "view", FAILURES[1]).when(kind == "click", "NO RECORD FOUND").otherwise("OK")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("citation_id"), text("S", F.col("event_id") % 3).alias("source"), status.alias("status"))
    return unavailable(rows).select(F.col("citation_id").alias("user_id"), F.array_join("unavailable", ",").alias("unavailable"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'OK' WHEN 1 THEN 'LOOKUP FAILED' WHEN 2 THEN 'NO RECORD FOUND' WHEN 3 THEN 'RATE LIMITED' WHEN 4 THEN 'LOOKUP FAILED' ELSE 'LOOKUP FAILED' END AS status, CASE event_id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'NO RECORD FOUND' ELSE 'LOOKUP FAILED' END AS resolved FROM events")
def response_statuses(spark, sf_dir):
    k = F.col("event_id") % 6
    http = F.when(k == 0, 200).when(k == 1, 503).when(k == 2, 404).when(k == 3, 429).when(k == 4, F.lit(None)).otherwise(200)
    body = F.when(k == 5, "<html>busy</html>").otherwise(F.col("props"))
    code = F.when(k % 3 == 0, 1).when(k % 3 == 1, 100).otherwise(200)
    return table(spark, sf_dir, "events").select("event_id", json_status(http.cast("int"), body).alias("status"), resolver_status(code).alias("resolved"))


@query(
    """WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Crossref' WHEN 1 THEN 'DBLP' ELSE 'OpenAlex' END AS s, event_id // 3 AS k, least(5000, greatest(1000, event_id % 9 * 1000)) AS w FROM events),
    c AS (SELECT *, k % 7 AS a1, k // 7 % 7 AS a2, k // 49 % 7 AS b1, k // 343 % 7 AS b2 FROM e),
    f AS (SELECT *, CASE WHEN a1 = 0 THEN a2 ELSE a1 END AS a, CASE WHEN b1 = 0 THEN b2 ELSE b1 END AS b FROM c),
    g AS (SELECT *, (s = 'Crossref' AND a = 1) OR (s = 'DBLP' AND a = 2) AS again FROM f),
    h AS (SELECT *, CASE WHEN again THEN b ELSE a END AS x FROM g)
    SELECT event_id, CASE WHEN x = 0 THEN 'RATE LIMITED' WHEN x IN (1, 2, 4) THEN 'LOOKUP FAILED' WHEN x = 3 THEN 'NO RECORD FOUND' ELSE 'OK' END AS status,
      CAST(1 + (a1 = 0)::INTEGER + CASE WHEN again THEN 1 + (b1 = 0)::INTEGER ELSE 0 END AS INTEGER) AS asked,
      CAST(CASE WHEN a1 = 0 THEN w ELSE 0 END + CASE WHEN again THEN CASE WHEN s = 'DBLP' THEN 800 ELSE 0 END + CASE WHEN b1 = 0 THEN w ELSE 0 END ELSE 0 END AS BIGINT) AS waited_ms,
      CASE WHEN x > 4 THEN length(props) END AS body_chars FROM h JOIN events USING (event_id)"""
)
def request_retries(spark, sf_dir):
    """Searches of three sources, each event with an answer for every try: refusals, rejected searches, pages in place of JSON."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    source = F.element_at(F.array(*map(F.lit, ("Crossref", "DBLP", "OpenAlex"))), (F.col("event_id") % 3 + 1).cast("int"))
    requests = events.select(F.col("event_id").alias("request_id"), source.alias("source"), F.lit("search").alias("operation"))
    tries = F.array(*[F.struct(F.lit(r).alias("round"), F.lit(t).alias("try"), F.lit(step).alias("step")) for r, t, step in ((1, 1, 3), (1, 2, 21), (2, 1, 147), (2, 2, 1029))])
    every = events.select("event_id", "props", F.explode(tries).alias("x")).select("event_id", "props", "x.*")
    code = F.floor(F.col("event_id") / F.col("step")) % 7
    http = F.when(code == 0, 429).when(code == 1, 400).when(code == 3, 404).when(code == 4, F.lit(None)).otherwise(200)
    body = F.when(code == 2, F.lit("<html>busy</html>")).when(code > 4, F.col("props"))
    answers = every.select(F.col("event_id").alias("request_id"), "round", "try", http.alias("http"), body.alias("body"), (F.col("event_id") % 9).cast("string").alias("retry_after"), F.lit(False).alias("offline"))
    rows = ask_again(requests, recorded(answers))
    return rows.select(F.col("request_id").alias("event_id"), "status", "asked", "waited_ms", F.length("body").cast("bigint").alias("body_chars"))


@query(
    """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 3600.0 ELSE 86400.0 END AS ttl FROM events),
    f AS (SELECT user_id, n, event_id, false AS from_cache, CASE WHEN ttl IS NULL THEN -1e18 ELSE epoch_us(ts) / 1e6 + ttl END AS until FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.n, e.event_id, epoch_us(e.ts) / 1e6 < f.until, CASE WHEN epoch_us(e.ts) / 1e6 < f.until OR e.ttl IS NULL THEN f.until ELSE epoch_us(e.ts) / 1e6 + e.ttl END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT event_id, from_cache FROM f"""
)
def ttl_cache(spark, sf_dir):
    """Events of a user as requests for one key: errors fail, views find nothing (an hour), others are found (a day)."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "LOOKUP FAILED").when(kind == "view", "NO RECORD FOUND").otherwise("OK")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), at.alias("at"), F.col("event_id").alias("request_id"), status.alias("status"))
    return replay_cache(rows, found_s=86400, absent_s=3600).select(F.col("request_id").alias("event_id"), "from_cache")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN -1.0 WHEN 'view' THEN 86400.0 ELSE 2592000.0 END::DOUBLE AS ttl FROM events")
def cache_lifetimes(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "error", "RATE LIMITED").when(kind == "view", "NO RECORD FOUND").otherwise("OK")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(lifetime(status), F.lit(-1.0)).alias("ttl"))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, event_type, (epoch_us(ts) // 1000)::BIGINT AS a, 200 + event_id % 700 AS s, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
    f AS (SELECT event_type, n, event_id, a AS start, a + s + 300000 AS free FROM e WHERE n = 1
      UNION ALL SELECT e.event_type, e.n, e.event_id, greatest(e.a, f.free), greatest(e.a, f.free) + e.s + 300000 FROM f JOIN e ON e.event_type = f.event_type AND e.n = f.n + 1)
    SELECT event_id, start::BIGINT AS start FROM f"""
)
def paced_requests(spark, sf_dir):
    """Events of a type as requests to one host, five minutes apart."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("host"), at.alias("arrival"), F.col("event_id").alias("request_id"), (F.col("event_id") % 700 + 200).alias("service"), F.lit(300000).cast("bigint").alias("gap"))
    return paced_starts(rows).select(F.col("request_id").alias("event_id"), F.col("start").cast("bigint").alias("start"))


@query(
    """WITH n AS (SELECT DISTINCT p_name FROM part), c AS (SELECT p_partkey, 'the ' || p_name AS t FROM part), w AS (SELECT p_name, p_name || ' study' AS t FROM n),
    p AS (SELECT c.p_partkey, w.p_name, w.t, len(list_intersect(string_split(c.t, ' '), string_split(w.t, ' '))) / 3.0 AS dice, 1 - levenshtein(c.t, w.t)::DOUBLE / greatest(length(c.t), length(w.t)) AS edit FROM c, w),
    s AS (SELECT *, 0.6 * dice + 0.4 * edit AS sim FROM p WHERE dice > 0.5)
    SELECT p_partkey, p_name, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY sim DESC, t) AS INTEGER) AS place, round(sim, 6) AS similarity FROM s WHERE sim >= 0.55 QUALIFY place <= 3"""
)
def title_search(spark, sf_dir):
    """Titles found by rare words, the three most similar of each."""
    part = table(spark, sf_dir, "part")
    wanted = part.select(F.col("p_partkey").alias("citation_id"), text("the ", F.col("p_name")).alias("norm_title"))
    works = part.select("p_name").distinct().select(work(title=text(F.col("p_name"), " study"), venue=F.col("p_name")).alias("work"))
    hits = search_titles(wanted, with_norm_title(works), 3, 0.55)
    return hits.select(F.col("citation_id").alias("p_partkey"), F.col("work.venue").alias("p_name"), "place", F.round("similarity", 6).alias("similarity"))


# ---- scores and candidates ----
@query(
    """SELECT p_partkey, round(CASE WHEN n <= 1 THEN least(t, 0.75) ELSE t END, 6) AS total, CASE WHEN u >= 0.95 THEN 'VERY HIGH' WHEN u >= 0.85 THEN 'HIGH' WHEN u >= 0.7 THEN 'POSSIBLE' ELSE 'LOW' END AS confidence, floor(u * 1000 + 0.5) / 1000 AS rounded FROM (
      SELECT *, CASE WHEN n <= 1 THEN least(t, 0.75) ELSE t END AS u FROM (
        SELECT p_partkey, (0.35::DOUBLE * coalesce(a, 0) + 0.3::DOUBLE * coalesce(b, 0) + 0.1::DOUBLE * coalesce(c, 0)) / nullif((a IS NOT NULL)::INT * 0.35::DOUBLE + (b IS NOT NULL)::INT * 0.3::DOUBLE + (c IS NOT NULL)::INT * 0.1::DOUBLE, 0) AS t,
          (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n FROM (
          SELECT p_partkey, (p_size / 50.0)::DOUBLE AS a, CASE WHEN p_partkey % 3 = 0 THEN ((p_partkey % 101) / 100.0)::DOUBLE END AS b, CASE WHEN p_partkey % 5 < 2 THEN CASE abs(p_size - 25) WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.0 END::DOUBLE END AS c FROM part)))"""
)
def score_weighted(spark, sf_dir):
    key = F.col("p_partkey")
    parts = {"title": F.col("p_size") / 50.0, "authors": F.when(key % 3 == 0, (key % 101) / 100.0), "venue": F.lit(None).cast("double"), "year": F.when(key % 5 < 2, year_score(F.col("p_size"), F.lit(25))), "publisher": F.lit(None).cast("double")}
    rows = table(spark, sf_dir, "part").select("p_partkey", weighted_score(parts).alias("t"))
    return rows.select("p_partkey", F.round("t", 6).alias("total"), confidence_for(F.col("t")).alias("confidence"), rounded(F.col("t")).alias("rounded"))


@query(
    """WITH r AS (SELECT *, p_partkey % 5 AS k, CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 4 END AS rank FROM part)
    SELECT p_name, first(p_type ORDER BY rank, p_partkey) FILTER (WHERE k <> 1) AS publisher, CAST(first(1950 + p_size ORDER BY rank, p_partkey) AS INTEGER) AS year, first(p_brand ORDER BY rank, p_partkey) FILTER (WHERE p_size > 10) AS venue, first(k = 4 ORDER BY rank, p_partkey) AS is_preprint, count(DISTINCT p_brand) > 1 AS disagree FROM r GROUP BY p_name"""
)
def precedence_merge(spark, sf_dir):
    """Parts of one name as records of five sources; absent values are passed over."""
    k = F.col("p_partkey") % 5
    sources = F.array(*[from_source(n) for n in ("DBLP", "Crossref", "OpenAlex", "DataCite", "arXiv")])
    w = work(title=F.col("p_name"), publisher=F.when(k == 1, "").otherwise(F.col("p_type")), year=F.col("p_size") + 1950, venue=F.when(F.col("p_size") > 10, F.col("p_brand")), is_preprint=k == 4, sources=F.get(sources, k.cast("int")))
    rows = table(spark, sf_dir, "part").select("p_name", F.col("p_partkey").alias("place"), w.alias("work"), "p_brand")
    merged = merge_records(rows.select("p_name", "place", "work"), ("p_name",))
    brands = rows.groupBy("p_name").agg((F.count_distinct("p_brand") > 1).alias("disagree"))
    return merged.join(brands, "p_name").select("p_name", "work.publisher", "work.year", "work.venue", "work.is_preprint", "disagree")


@query("SELECT p_brand, CAST(g AS INTEGER) AS grp, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_brand, p_name, dense_rank() OVER (PARTITION BY p_brand ORDER BY f) - 1 AS g FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS f FROM part)) GROUP BY p_brand, g")
def first_fit_groups(spark, sf_dir):
    """Parts of a brand grouped by name in order of arrival."""
    rows = table(spark, sf_dir, "part").withColumn("place", (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).cast("int"))
    kind = F.min("place").over(Window.partitionBy("p_brand", "p_name"))
    rows = rows.select(F.col("p_brand").alias("citation_id"), "place", kind.alias("class"), F.lit(None).cast("int").alias("twin"))
    sets = first_fit_rows(rows.withColumn("matches", F.when(F.col("place") == F.col("class"), F.array("class"))))
    return sets.groupBy(F.col("citation_id").alias("p_brand"), F.col("group").alias("grp")).agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE p AS (SELECT p_brand AS b, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place, lower(p_name || ' of the ' || p_type || ' kind') AS t, p_size AS y FROM part),
    w AS (SELECT b, place, t, y, string_split(t, ' ') AS l FROM p),
    m AS (SELECT x.b, x.place, e.place AS i, x.t = e.t AS twin, abs(x.y - e.y) <= 1 AND (x.t = e.t OR greatest(
        0.6 * 2 * list_sum(list_transform(list_distinct(x.l), lambda v: least(len(list_filter(x.l, lambda u: u = v)), len(list_filter(e.l, lambda u: u = v)))))::DOUBLE / (len(x.l) + len(e.l))
        + 0.4 * (1 - levenshtein(x.t, e.t) / greatest(length(x.t), length(e.t))),
        CASE WHEN least(length(x.t), length(e.t)) >= 20 AND (starts_with(x.t, e.t) OR starts_with(e.t, x.t)) THEN 0.9 ELSE 0 END) >= 0.9) AS same FROM w x JOIN w e ON e.b = x.b AND e.place < x.place),
    listed AS (SELECT p.b, p.place, coalesce(list(i) FILTER (same), []) AS same, coalesce(list(i) FILTER (twin), []) AS twin FROM p LEFT JOIN m ON m.b = p.b AND m.place = p.place GROUP BY ALL),
    joined AS (SELECT b, place, [0] AS g FROM listed WHERE place = 0 UNION ALL
      SELECT b, place, list_append(g, CASE WHEN j IS NULL THEN greatest(list_max(g) + 1, 0) WHEN list_contains(list_transform(twin, lambda k: g[k + 1]), j) THEN -1 ELSE j END)
      FROM (SELECT l.b, l.place, l.twin, r.g, list_min(list_filter(list_transform(l.same, lambda k: r.g[k + 1]), lambda v: v >= 0)) AS j FROM joined r JOIN listed l ON l.b = r.b AND l.place = r.place + 1)),
    whole AS (SELECT b, arg_max(g, place) AS g FROM joined GROUP BY b)
    SELECT citation_id, place, "group" FROM (SELECT b AS citation_id, unnest(range(len(g)))::INTEGER AS place, unnest(g)::INTEGER AS "group" FROM whole) WHERE "group" >= 0"""
)
def group_works(spark, sf_dir):
    """Parts of a brand as records in order of arrival: each joins the first group that it matches, repeats are left out."""
    rows = table(spark, sf_dir, "part")
    w = work(title=text(F.col("p_name"), " of the ", F.col("p_type"), " kind"), year=F.col("p_size") + 1950, sources=from_source("Crossref"))
    return group_records(rows.select(F.col("p_brand").alias("citation_id"), F.col("p_partkey").alias("pos"), w.alias("work"))).select("citation_id", "place", "group")


def _citation_of_part():
    """A part as a citation: its name, two authors and a year."""
    key = F.col("p_partkey")
    authors = F.array(person(letters(key), "Jo"), person(F.lit("roe"), "Al"))
    return dict(title=text(F.col("p_name"), " ", letters(key)), authors=authors, year=F.col("p_size") + 1950, venue=F.col("p_type"))


def _records_of_part(spark, sf_dir: str):
    """For each part: itself from two sources, a preprint three years older, and another work."""
    rows = table(spark, sf_dir, "part")
    c = _citation_of_part()
    key = F.col("p_partkey")
    made = [
        work(**c, doi=text("10.5555/", key), sources=from_source("Crossref")),
        work(**c, publisher=F.col("p_brand"), sources=from_source("DBLP")),
        work(**{**c, "year": c["year"] - 3, "venue": F.lit("arXiv")}, is_preprint=F.lit(True), doi=text("10.48550/arXiv.", key), sources=from_source("arXiv")),
        work(**{**c, "title": text("unrelated ", F.col("p_brand")), "authors": F.array(person(F.lit("other"), "Zed"))}, sources=from_source("OpenAlex")),
        work(**{**c, "title": F.lit(None)}, sources=from_source("OpenAlex")),
    ]
    records = rows.select(key.alias("citation_id"), F.posexplode(F.array(*made)).alias("pos", "work"))
    cited = rows.select(key.alias("citation_id"), work(**c).alias("work"), F.lit(False).alias("authors_truncated"))
    return cited, records


@query(
    """SELECT p_partkey, u.p AS place, u.t::DOUBLE AS total, u.s AS state, u.r AS records, u.v AS doi FROM part,
    LATERAL (SELECT * FROM (VALUES (0, 1.0, 'VERIFIED', 2, '10.5555/' || p_partkey), (1, 0.722, 'UNVERIFIED', 1, '10.48550/arXiv.' || p_partkey)) AS v(p, t, s, r, v)) AS u"""
)
def candidate_ranking(spark, sf_dir):
    """Two records of one version merge; the preprint is a version of it, the other work is too unlike to be shown."""
    cited, records = _records_of_part(spark, sf_dir)
    c = build_candidates(cited, records)
    return c.select(F.col("citation_id").alias("p_partkey"), F.col("place").cast("int").alias("place"), "score.total", "score.state", F.size("records").alias("records"), "work.doi")


@query("SELECT p_partkey, 0 AS selected, false AS ambiguous, 0 AS published, 1 AS preprint FROM part")
def candidate_selection(spark, sf_dir):
    cited, records = _records_of_part(spark, sf_dir)
    s = select_candidate(cited, build_candidates(cited, records))
    return s.select(F.col("citation_id").alias("p_partkey"), "selected", "ambiguous", "published", "preprint")


@query(
    """WITH t AS (SELECT p_partkey, p_brand, round((p_size / 50.0)::DOUBLE, 3) AS s, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n FROM part),
    b AS (SELECT p_brand, max(s) AS top, min(p_partkey) FILTER (WHERE n = 1) AS best, max(s) FILTER (WHERE n > 1) AS second FROM t GROUP BY p_brand)
    SELECT p_brand, best, CASE WHEN top < 0.7 THEN 'weak' WHEN second >= 0.7 AND top - second < 0.06::DOUBLE THEN 'ambiguous' ELSE 'chosen' END AS outcome FROM b"""
)
def ambiguity_gap(spark, sf_dir):
    """Parts of a brand as distinct candidates, scored by size: best, runner-up and the gap between."""
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")
    score = F.struct(F.round(F.col("p_size") / 50, 3).alias("total"), F.lit(False).alias("identifier_match"), F.lit("UNVERIFIED").alias("state"))
    rows = table(spark, sf_dir, "part").withColumn("place", F.row_number().over(order) - 1)
    c = rows.select(F.col("p_brand").alias("citation_id"), "place", work(title=F.col("p_name")).alias("work"), score.alias("score"), F.col("place").cast("int").alias("version_group"), "p_partkey")
    s = select_candidate(rows.select(F.col("p_brand").alias("citation_id")).distinct(), c)
    outcome = F.when(F.col("ambiguous"), "ambiguous").when(F.col("selected").isNotNull(), "chosen").otherwise("weak")
    return s.join(c.filter("place = 0").select("citation_id", "p_partkey"), "citation_id").select(F.col("citation_id").alias("p_brand"), F.col("p_partkey").alias("best"), outcome.alias("outcome"))


@query(
    """SELECT p_partkey, u.i AS id, u.s AS state FROM part, LATERAL (SELECT * FROM (VALUES
      ('doi-syntax', CASE WHEN p_partkey % 5 = 0 THEN 'CONFLICT' ELSE 'VERIFIED' END), ('doi-resolve', CASE p_partkey % 5 WHEN 1 THEN 'CONFLICT' WHEN 2 THEN 'NOT CHECKED' ELSE 'VERIFIED' END),
      ('doi-meta', CASE p_partkey % 5 WHEN 1 THEN 'UNVERIFIED' WHEN 2 THEN 'NOT CHECKED' ELSE 'VERIFIED' END), ('doi-identity', CASE p_partkey % 5 WHEN 3 THEN 'CONFLICT' ELSE 'VERIFIED' END)) AS v(i, s)) AS u
    WHERE (p_partkey % 5 > 0 OR u.i = 'doi-syntax') AND (p_partkey % 5 > 2 OR p_partkey % 5 = 0 OR u.i <> 'doi-identity')"""
)
def doi_check_levels(spark, sf_dir):
    """DOIs that are none, are unknown, could not be asked, belong to another work, and fit."""
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, "n/a").otherwise(text("10.5555/", F.col("p_partkey")))
    status = F.when(k == 1, "NO RECORD FOUND").when(k == 2, "RATE LIMITED").otherwise("OK")
    against = F.when(k == 3, F.array(F.lit(WRONG_DOI))).otherwise(F.array().cast("array<string>"))
    score = F.struct(against.alias("contradictions"), F.lit("VERIFIED").alias("state"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(doi_checks(raw, status, F.lit("http://x"), status, F.lit("Crossref"), score, F.col("p_name"))).alias("c"))
    return rows.select("p_partkey", "c.id", "c.state")


@query("SELECT nation.n_nationkey, n_name || ' x' AS a, CAST(1.0 AS DOUBLE) AS similarity FROM nation")
def title_identity(spark, sf_dir):
    """Spellings that differ in case, braces, accents and dashes only."""
    name = F.col("n_name")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", text(name, " x").alias("a"), normalized(text("{", name, "}-\\'X")).alias("p"), normalized(text(F.lower(name), " — x")).alias("q"))
    return rows.select("n_nationkey", "a", title_similarity(F.col("p"), F.col("q")).alias("similarity"))




@query(
    """WITH n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT a.p_partkey, b.p_name AS found,
      CASE WHEN a.p_name = b.p_name THEN 1.0 ELSE 0.6 * 0.5 + 0.4 * (1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name))) END AS s
      FROM part a JOIN n b ON split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) OR split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2))
    SELECT p_partkey, found, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, found) AS INTEGER) AS place FROM p WHERE s >= 0.55 QUALIFY place <= 3"""
)
def entry_candidates(spark, sf_dir):
    """Entries read from text, and the three most similar titles of each: parse, normalise, block, compare, rank."""
    made = text("@book{p", F.col("p_partkey"), ",\n  title = {{", F.initcap("p_name"), "}},\n  year = ", F.col("p_size") + 1950, "\n}")
    titles = fields(items(table(spark, sf_dir, "part").select("p_partkey", made.alias("text")), "p_partkey")).filter("name = 'title'")
    wanted = stored(titles.select(F.col("file_id").alias("citation_id"), normalized("text").alias("norm_title")), "wanted")
    works = table(spark, sf_dir, "part").select("p_name").distinct().select(work(title=F.col("p_name")).alias("work"))
    hits = search_titles(wanted, with_norm_title(works), 3, 0.55)
    return hits.select(F.col("citation_id").alias("p_partkey"), F.col("work.title").alias("found"), F.round("similarity", 6).alias("similarity"), "place")


class _ByTitle:
    """A source that knows titles exactly."""

    by_doi = False

    def __init__(self, name: str, works: DataFrame):
        self.name, self.works = name, works

    def search(self, wanted: DataFrame) -> DataFrame:
        found = wanted.join(self.works, "norm_title", "left")
        status = F.when(F.col("work").isNull(), "NO RECORD FOUND").otherwise("OK")
        return found.select("citation_id", F.lit(0).alias("pos"), status.alias("status"), "work")


@query(
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 11 = 0 AS pre, p_partkey % 13 > 0 AS no_doi FROM part),
    c AS (SELECT *, k % 4 = 0 AS s1 FROM p), d AS (SELECT *, NOT s1 OR pre AS asked2, (NOT s1 OR pre) AND k % 6 = 0 AS s2 FROM c),
    o AS (SELECT *, NOT (s1 OR s2) AS asked3, NOT (s1 OR s2) AND k % 5 = 0 AS s3 FROM d),
    b AS (SELECT *, NOT asked2 AS asked4, NOT asked2 AND k % 6 = 0 AS s4 FROM o), e AS (SELECT *, no_doi AND NOT (s1 OR s2 OR s3 OR s4) AS asked5 FROM b)
    SELECT k AS p_partkey, u.s AS source, u.t AS status FROM e, LATERAL (SELECT * FROM (VALUES (true, 'Crossref', k % 2 = 0), (asked2 OR asked4, 'DBLP', k % 3 = 0), (asked3, 'OpenAlex', k % 5 = 0), (asked5, 'DataCite', k % 7 = 0)) AS v(a, s, f)) AS w,
    LATERAL (SELECT w.s, CASE WHEN w.f THEN 'OK' ELSE 'NO RECORD FOUND' END AS t) AS u WHERE w.a"""
)
def lookup_tiered(spark, sf_dir):
    """Which sources are asked for which citation, and what they say: later ones only for what is not settled by then."""
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    title = text(F.col("p_name"), " ", letters(key))
    asked = part.select(key.alias("citation_id"), title.alias("norm_title"), (key % 11 == 0).alias("wants_published"), (key % 13 > 0).alias("no_doi"), F.lit(True).alias("clean"), F.lit(True).alias("discover"))
    w = lambda n: work(title=title, publisher=F.when(key % n == 0, "strong"))
    source = lambda name, knows, strong: _ByTitle(name, part.filter(key % knows == 0).select(title.alias("norm_title"), w(strong).alias("work")))
    sources = {s.name: s for s in (source("Crossref", 2, 4), source("DBLP", 3, 6), source("OpenAlex", 5, 5), source("DataCite", 7, 7))}
    judge = lambda got: got.withColumn("strong", F.coalesce(F.col("work.publisher") == "strong", F.lit(False)))
    none = judge(part.limit(0).select(key.alias("citation_id"), F.lit(0).alias("tier"), F.lit(0).alias("nth"), w(1).alias("work")))
    tiered = search_tiers(stored(asked, "asked"), stored(none, "none"), sources, judge)
    log = tiered.statuses[0]
    for more in tiered.statuses[1:]:
        log = log.unionByName(more)
    return log.select(F.col("citation_id").alias("p_partkey"), "source", "status")
