"""Queries over the rules of evaluation: each part is an entry that is wrong in one of eight ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordcheck.functions.authors import first_family
from recordcheck.functions.venue import venue_keys, venue_similarity
from recordcheck.operators.candidates import nothing_checked, override_selection
from recordcheck.operators.citations import build_citations
from recordcheck.operators.evaluate import check_rows, comparison_rows, disagreement, evaluate, suggestion_rows
from recordcheck.plans.queries_match import from_source, person, work
from recordcheck.plans.registry import query, table, text
from recordcheck.schema import CHECK
from recordcheck.sources.bibtex import entries, fields, items, list_entries, list_summary, shown_choices
from recordcheck.storage import stored


def _evaluated(spark, sf_dir: str, equal: bool = False):
    """equal: the records have the entries' values, written in other ways."""
    part = table(spark, sf_dir, "part")
    key, name = F.col("p_partkey"), F.col("p_name")
    v = key % 8
    year = F.col("p_size") + 1950
    title, lead, dated = text("  title = {A Study of ", name, "},\n"), "  author = {Jo Doe},\n", text("  year = {", year, "},\n")
    entry = (
        F.when(v == 0, text("@inproceedings{k", key, ",\n", title, lead, dated, "  booktitle = {Journal of Parts}\n}"))
        .when(v == 1, text("@book{k", key, ",\n", title, lead, dated, "  publisher = {Alpha Press},\n  isbn = {111-1}\n}"))
        .when(v == 2, text("@article{k", key, ",\n", title, lead, dated, "  journal = {Journal of Parts},\n  volume = {3},\n  number = {1},\n  issn = {0000-0000}\n}"))
        .when(v == 3, text("@article{k", key, ",\n", title, "  author = {Ann Bee and Cy Dee},\n", dated, "  journal = {Journal of Parts}\n}"))
        .when(v == 4, text("@article{k", key, ",\n  title = {Nothing Like It At All},\n", lead, dated, "  journal = {Journal of Parts}\n}"))
        .when(v == 5, text("@article{k", key, ",\n", title, lead, dated, "  journal = {Annals of Cooking}\n}"))
        .when(v == 6, text("@misc{k", key, ",\n", title, lead, "  year = {", year - 1, "},\n  eprint = {2301.00001},\n  archiveprefix = {arXiv}\n}"))
        .otherwise(text("@article{k", key, ",\n", title, lead, dated, "  journal = {Journal of Parts},\n  doi = {10.5555/other},\n  url = {http://example.org/gone}\n}"))
    )
    parsed = stored(items(part.select("p_partkey", entry.alias("text")), "p_partkey"), "parsed")
    cited = build_citations(entries(parsed), fields(parsed))
    listed = lambda x: F.array(F.lit(x))
    record = work(
        title=text("A Study of ", name), authors=F.array(person(F.lit("Doe"), "Jo")), year=year, venue=F.when(v != 1, "Journal of Parts"), type=F.when(v == 1, "book").otherwise("article"), doi=text("10.5555/", key),
        volume=F.when(v == 2, "{3}" if equal else "4"), issue=F.when(v == 2, " 1 " if equal else "2"), publisher=F.when(v == 1, "The ALPHA-Press" if equal else "Omega House"),
        isbn=F.when(v == 1, F.array(F.lit("978"), F.lit("1111")) if equal else listed("9780000000002")), issn=F.when(v == 2, listed("00000000") if equal else listed("1234-5678")), sources=from_source("Crossref"),
    )
    score = F.struct(
        F.lit(0.97).alias("total"), F.lit(True).alias("identifier_match"), F.array().cast("array<string>").alias("contradictions"), F.lit("VERY HIGH").alias("confidence"), F.lit("VERIFIED").alias("state")
    )
    pairs = cited.join(part.select(key.alias("file_id"), v.alias("v"), record.alias("rec")).hint("merge"), "file_id")
    gone = F.struct(F.lit("UNREACHABLE").alias("state"), F.lit("x").alias("label"), F.lit("x").alias("detail"), F.lit(None).cast("string").alias("final_url"), F.lit(None).cast("string").alias("page_title"))
    ready = pairs.withColumns({"cand": F.struct(F.col("rec").alias("work"), F.array("rec").alias("records"), score.alias("score")), "doi_checks": F.array().cast(f"array<{CHECK}>"), "url_check": F.when(F.col("v") == 7, gone), "existing_keys": F.array("key")})
    return evaluate(ready)


@query(
    """SELECT p_partkey, u.f AS field, u.s AS status FROM part, LATERAL (SELECT * FROM (VALUES
      ('entry type', CASE WHEN p_partkey % 8 IN (0, 6) THEN 'CONFLICT' ELSE 'VERIFIED' END),
      ('title', CASE WHEN p_partkey % 8 = 4 THEN 'CONFLICT' ELSE 'VERIFIED' END),
      ('author', CASE WHEN p_partkey % 8 = 3 THEN 'CONFLICT' ELSE 'VERIFIED' END),
      ('year', CASE WHEN p_partkey % 8 = 6 THEN 'CONFLICT' ELSE 'VERIFIED' END),
      (CASE WHEN p_partkey % 8 = 0 THEN 'booktitle' ELSE 'journal' END, CASE p_partkey % 8 WHEN 1 THEN NULL WHEN 5 THEN 'CONFLICT' WHEN 6 THEN 'MISSING' ELSE 'VERIFIED' END),
      ('publisher', CASE WHEN p_partkey % 8 = 1 THEN 'CONFLICT' END), ('isbn', CASE WHEN p_partkey % 8 = 1 THEN 'CONFLICT' END),
      ('volume', CASE WHEN p_partkey % 8 = 2 THEN 'CONFLICT' END), ('number', CASE WHEN p_partkey % 8 = 2 THEN 'CONFLICT' END), ('issn', CASE WHEN p_partkey % 8 = 2 THEN 'CONFLICT' END),
      ('doi', CASE WHEN p_partkey % 8 = 7 THEN 'CONFLICT' ELSE 'MISSING' END), ('url', CASE WHEN p_partkey % 8 = 7 THEN 'UNREACHABLE' END)) AS v(f, s)) AS u WHERE u.s IS NOT NULL"""
)
def rule_statuses(spark, sf_dir):
    """How each field compares, for entries of a wrong type, publisher, volume, author, title, venue, version and DOI."""
    rows = comparison_rows(_evaluated(spark, sf_dir))
    return rows.select(F.split("citation_id", ":")[0].cast("bigint").alias("p_partkey"), "field", "status")


@query(
    """SELECT p_partkey, u.f AS field, u.o AS operation, u.c AS category, u.k AS kind, u.s AS suggested, u.q AS confidence FROM part, LATERAL (SELECT * FROM (VALUES
      (0, 'ENTRYTYPE', 'replace', 'conflict', 'set', '@article', 'VERY HIGH'), (0, 'booktitle', 'rename', 'conflict', 'rename', 'journal', 'VERY HIGH'),
      (1, 'publisher', 'replace', 'conflict', 'set', 'Omega House', 'HIGH'), (1, 'isbn', 'replace', 'conflict', 'set', '9780000000002', 'HIGH'),
      (2, 'volume', 'replace', 'conflict', 'set', '4', 'HIGH'), (2, 'number', 'replace', 'conflict', 'set', '2', 'HIGH'), (2, 'issn', 'replace', 'conflict', 'set', '1234-5678', 'HIGH'),
      (3, 'author', 'replace', 'conflict', 'set', 'Doe, Jo', 'HIGH'), (4, 'title', 'replace', 'conflict', 'set', 'A Study of ' || p_name, 'HIGH'), (5, 'journal', 'replace', 'conflict', 'set', 'Journal of Parts', 'HIGH'),
      (6, 'ENTRYTYPE', 'replace', 'version', 'set', '@article', 'VERY HIGH'), (6, 'year', 'replace', 'version', 'set', (1950 + p_size)::VARCHAR, 'VERY HIGH'), (6, 'journal', 'add', 'version', 'set', 'Journal of Parts', 'VERY HIGH'),
      (p_partkey % 8, 'doi', CASE WHEN p_partkey % 8 = 7 THEN 'replace' ELSE 'add' END, CASE p_partkey % 8 WHEN 7 THEN 'conflict' WHEN 6 THEN 'version' ELSE 'missing' END, 'set', '10.5555/' || p_partkey, CASE WHEN p_partkey % 8 = 7 THEN 'HIGH' ELSE 'VERY HIGH' END),
      (CASE WHEN p_partkey % 8 < 7 THEN p_partkey % 8 END, 'url', 'add', CASE WHEN p_partkey % 8 = 6 THEN 'version' ELSE 'format' END, 'set', 'https://doi.org/10.5555/' || p_partkey, 'VERY HIGH'),
      (p_partkey % 8, 'KEY', 'replace', 'key', 'set', CASE WHEN p_partkey % 8 = 6 THEN 'doe_' || (1949 + p_size) || '_study_arxiv' ELSE 'doe_' || (1950 + p_size) || '_study' END, 'HIGH')) AS v(n, f, o, c, k, s, q)) AS u WHERE u.n = p_partkey % 8"""
)
def rule_suggestions(spark, sf_dir):
    """What is suggested for them: nothing links to a DOI under suspicion, and a preprint's changes are of their own kind."""
    rows = suggestion_rows(_evaluated(spark, sf_dir)).filter("field <> 'ENTRY'")
    return rows.select(F.split("citation_id", ":")[0].cast("bigint").alias("p_partkey"), "field", "operation", "category", "kind", "suggested", "confidence")


def _library(spark, sf_dir: str):
    """Parts of a name as one file, one entry each, with a part that can't be read at its end."""
    rows = table(spark, sf_dir, "part").select("p_name", "p_partkey", text("@book{p", F.col("p_partkey") % 100, ", title = {", F.col("p_name"), "}}").alias("entry"))
    made = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "entry"))), lambda e: e["entry"]), "\n")
    return items(rows.groupBy("p_name").agg(text(made, "\n@book{never, title = {closed").alias("text")), "p_name")


@query("SELECT p_name, array_to_string(list_sort(list(DISTINCT 'p' || (p_partkey % 100))), ',') AS keys, count(*)::BIGINT AS entries, 1::BIGINT AS errors FROM part GROUP BY p_name")
def entry_summary(spark, sf_dir):
    """Keys, entries and unreadable parts of each file."""
    return list_summary(_library(spark, sf_dir)).select(F.col("file_id").alias("p_name"), F.array_join("keys", ",").alias("keys"), "entries", "errors")


@query(
    """WITH e AS (SELECT p_name, CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS INTEGER) AS index, 'p' || (p_partkey % 100) AS key FROM part)
    SELECT * FROM e WHERE key LIKE '%1%' OR p_name LIKE '%1%' QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY index) <= 3"""
)
def entry_shown(spark, sf_dir):
    """The first three entries of each file whose key holds a 1, numbered by place in the file."""
    shown = shown_choices(list_entries(_library(spark, sf_dir)), "1", 3)
    return shown.select(F.col("file_id").alias("p_name"), "index", "key")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'The ' || s_name || ' Group' WHEN 1 THEN 'OBrien ' || s_name ELSE '' END AS family FROM supplier")
def first_family_names(spark, sf_dir):
    """The name that a search asks for: a group's, a family name without marks, none."""
    n, name = F.col("s_suppkey") % 3, F.col("s_name")
    group = F.struct(F.lit("").alias("family"), F.lit(None).cast("string").alias("given"), text("The {", name, "} Group").alias("literal"))
    one = F.array(F.when(n == 0, group).otherwise(person(text("O'Bri{\\\"e}n ", name), "Al")), person(F.lit("Second"), "Bo"))
    authors = F.when(n < 2, one).otherwise(F.slice(one, 1, 0))
    return table(spark, sf_dir, "supplier").select("s_suppkey", first_family(authors).alias("family"))


def _evaluated_more(spark, sf_dir: str):
    """Entries that are right but for how they are written, or have no match; of every eighth the second source has another title and year."""
    part = table(spark, sf_dir, "part")
    key, name = F.col("p_partkey"), F.col("p_name")
    v = key % 8
    year = F.col("p_size") + 1950
    title, dated, venue = text("  title = {A BERT Study of ", name, "},\n"), text("  year = {", year, "},\n"), "  journal = {Journal of Parts}\n}"
    entry = (
        F.when(v == 0, text("@article{k", key, ",\n", title, "  author = {Jo Doe},\n", dated, venue))
        .when(v == 1, text("@article{k", key, ",\n  title = {a bert study of ", name, "},\n  author = {Jo Doe and Al Roe},\n", dated, venue))
        .when(v == 2, text("@article{k", key, ",\n", title, "  author = {Jo Doe and others},\n", dated, venue))
        .when(v == 3, text("@article{k", key, ",\n", title, "  author = {J. Doe and A. Roe},\n", dated, venue))
        .when(v == 4, text("@article{k", key, ",\n", title, "  author = {Doe, Jo and Al Roe},\n", dated, venue))
        .when(v == 5, text("@misc{k", key, ",\n", title, "  author = {Jo Doe and Al Roe},\n", dated, "  howpublished = {arXiv preprint arXiv:2301.00001}\n}"))
        .when(v == 6, text("@article{k", key, ",\n", title, "  author = {Jo Doe and Al Roe},\n", dated, "  doi = {https://doi.org/10.5555/", key, "},\n  url = {http://example.org/gone},\n", venue))
        .otherwise(text("@misc{k", key, ",\n", title, "  author = {Jo Doe and Al Roe},\n", dated, "  note = {arXiv preprint arXiv:2301.00001}\n}"))
    )
    parsed = stored(items(part.select("p_partkey", entry.alias("text")), "p_partkey"), "parsed")
    cited = build_citations(entries(parsed), fields(parsed))
    given = F.when(v == 3, "Joanna").otherwise("Jo")
    of = lambda source, **more: work(
        **dict(title=text("A BERT Study of ", name), authors=F.array(person(F.lit("Doe"), given), person(F.lit("Roe"), "Al")), year=year, venue=F.when(v == 7, "arXiv").otherwise("Journal of Parts"), type=F.when(v == 7, "preprint").otherwise("article"),
               is_preprint=v == 7, arxiv_id=F.when(v == 7, "2301.00001"), doi=F.when(v != 7, text("10.5555/", key)), sources=from_source(source)) | more,
    )
    records = F.array(of("Crossref"), of("DBLP", title=F.when(v == 2, text("A Study of ", name)).otherwise(text("A BERT Study of ", name)), year=F.when(v == 2, year + 1).otherwise(year)))
    score = F.struct(F.lit(0.97).alias("total"), F.lit(True).alias("identifier_match"), F.array().cast("array<string>").alias("contradictions"), F.lit("VERY HIGH").alias("confidence"), F.lit("VERIFIED").alias("state"))
    pairs = cited.join(part.select(key.alias("file_id"), v.alias("v"), records.alias("records")).hint("merge"), "file_id")
    cand = F.when(F.col("v") > 0, F.struct(F.get("records", F.lit(0)).alias("work"), "records", score.alias("score")))
    gone = F.struct(F.lit("UNREACHABLE").alias("state"), F.lit("x").alias("label"), F.lit("x").alias("detail"), F.lit(None).cast("string").alias("final_url"), F.lit(None).cast("string").alias("page_title"))
    return evaluate(pairs.withColumns({"cand": cand, "doi_checks": F.array().cast(f"array<{CHECK}>"), "url_check": F.when(F.col("v") == 6, gone), "existing_keys": F.array("key")}))


def _part(c: str = "citation_id"):
    """The part that a citation was made of."""
    return F.split(c, ":")[0].cast("bigint").alias("p_partkey")


@query(
    """SELECT p_partkey, u.f AS field, u.o AS operation, u.c AS category, u.k AS kind, u.s AS suggested, u.q AS confidence FROM part, LATERAL (SELECT * FROM (VALUES
      (CASE WHEN p_partkey % 8 <> 1 THEN p_partkey % 8 END, 'title', 'format', 'format', 'wrap', '{BERT}', 'HIGH'), (1, 'title', 'format', 'format', 'set', 'A {BERT} Study of ' || p_name, 'HIGH'),
      (2, 'title', 'replace', 'conflict', 'set', 'A BERT Study of ' || p_name, 'VERY HIGH'), (2, 'author', 'replace', 'missing', 'set', 'Doe, Jo and Roe, Al', 'VERY HIGH'),
      (3, 'author', 'replace', 'missing', 'set', 'Doe, Joanna and Roe, Al', 'VERY HIGH'), (4, 'author', 'format', 'format', 'set', 'Doe, Jo and Roe, Al', 'HIGH'),
      (5, 'ENTRYTYPE', 'replace', 'version', 'set', '@article', 'VERY HIGH'), (5, 'journal', 'add', 'version', 'set', 'Journal of Parts', 'HIGH'), (5, 'howpublished', 'remove', 'version', 'remove', '(removed)', 'POSSIBLE'),
      (6, 'doi', 'format', 'format', 'set', '10.5555/' || p_partkey, 'VERY HIGH'), (6, 'url', 'replace', 'url', 'set', 'https://doi.org/10.5555/' || p_partkey, 'HIGH'),
      (7, 'eprint', 'add', 'missing', 'set', '2301.00001', 'VERY HIGH'), (7, 'archivePrefix', 'add', 'missing', 'set', 'arXiv', 'VERY HIGH')) AS v(n, f, o, c, k, s, q)) AS u WHERE u.n = p_partkey % 8"""
)
def rule_edits(spark, sf_dir):
    """Lost capitals, short author lists, full given names, mixed name forms, a preprint's venue, spelt-out DOIs, dead links and arXiv numbers."""
    made = F.col("field").isin("url", "doi") & (F.col("operation") == "add")
    rows = suggestion_rows(_evaluated_more(spark, sf_dir)).filter(~F.col("field").isin("ENTRY", "KEY") & ~made)
    return rows.select(_part(), "field", "operation", "category", "kind", "suggested", "confidence")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN 'No record chosen' ELSE 'Verified match: A BERT Study of ' || p_name END AS label, CASE WHEN p_partkey % 8 = 0 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS state FROM part"""
)
def rule_match(spark, sf_dir):
    """What the check of the match says, where there is one and where there is none."""
    return check_rows(_evaluated_more(spark, sf_dir)).filter("id = 'match'").select(_part(), "label", "state")


@query(
    """SELECT p_partkey, u.f AS field, CASE WHEN p_partkey % 8 = 2 THEN 'HIGH CONFIDENCE' ELSE 'VERIFIED' END AS status, 'Current BibTeX,Crossref+,DBLP' || CASE WHEN p_partkey % 8 = 2 THEN '-' ELSE '+' END AS evidence
    FROM part, LATERAL (SELECT unnest(['title', 'year']) AS f) AS u WHERE p_partkey % 8 > 0"""
)
def rule_evidence(spark, sf_dir):
    """What each source says, and which of them agree: where one does not, equal values are no longer verified."""
    rows = comparison_rows(_evaluated_more(spark, sf_dir)).filter("field IN ('title', 'year') AND status <> 'NOT CHECKED'")
    said = F.transform("evidence", lambda e: F.concat(e["source"], F.when(e["agrees"], "+").when(~e["agrees"], "-").otherwise("")))
    return rows.select(_part(), "field", "status", F.array_join(said, ",").alias("evidence"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 1 THEN split_part(p_name, ' ', 1) || 'x' END AS first, CASE WHEN p_partkey % 3 <> 1 THEN split_part(p_name, ' ', 2) || 'y' END AS second FROM part"""
)
def evidence_disagreement(spark, sf_dir):
    """Venues of which one is like both others, which are not alike: the two that disagree are named."""
    one, two = text(F.split("p_name", " ")[0], "x"), text(F.split("p_name", " ")[1], "y")
    both = text(one, " and ", two)
    k = F.col("p_partkey") % 3
    named = F.when(k == 0, F.array(both, one, two)).when(k == 1, F.array(both, one)).otherwise(F.array(one, both, two))
    keyed = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(named).alias("nth", "venue")).withColumn("k", venue_keys("venue"))
    told = keyed.groupBy("p_partkey").agg(F.sort_array(F.collect_list(F.struct("nth", "venue", "k"))).alias("v"))
    pair = disagreement(F.col("v"), lambda x, y: venue_similarity(x["k"], y["k"]) >= 0.85)
    return told.withColumn("pair", pair).select("p_partkey", "pair.first.venue", F.col("pair.second.venue").alias("second")).withColumnRenamed("venue", "first")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 0 END END::INTEGER AS selected,
    p_partkey % 3 = 0 AND p_partkey % 5 < 2 AND p_partkey % 7 > 0 AS nothing FROM part"""
)
def candidate_override(spark, sf_dir):
    """A user's own choice, which may be none, goes before what was selected; and whether anything was checked at all."""
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    chosen = part.select(key.alias("citation_id"), F.when(key % 3 > 0, 0).cast("int").alias("selected"))
    own = part.filter(key % 4 < 2).select(key.alias("citation_id"), F.when(key % 4 == 0, 1).cast("int").alias("chosen"))
    counts = part.select(key.alias("citation_id"), nothing_checked(F.when(key % 5 < 2, 2).otherwise(0), F.when(key % 3 > 0, 1).otherwise(0), F.when(key % 7 > 0, 0).otherwise(1)).alias("nothing"))
    return override_selection(chosen, own).join(counts, "citation_id").select(F.col("citation_id").alias("p_partkey"), "selected", "nothing")


@query(
    """SELECT p_partkey, u.f AS field, 'VERIFIED' AS status FROM part, LATERAL (SELECT * FROM (VALUES (1, 'publisher'), (1, 'isbn'), (2, 'volume'), (2, 'number'), (2, 'issn')) AS v(n, f)) AS u WHERE u.n = p_partkey % 8"""
)
def rule_equal_fields(spark, sf_dir):
    """Volumes, issues, publishers, ISBNs and ISSNs that are written in other ways are equal."""
    rows = comparison_rows(_evaluated(spark, sf_dir, True)).filter(F.col("field").isin("publisher", "isbn", "volume", "number", "issn"))
    return rows.select(_part(), "field", "status")
