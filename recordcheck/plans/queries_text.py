"""Queries over value functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordcheck.functions.authors import compare_authors, formatted_authors, parse_author, parse_authors
from recordcheck.functions.identifiers import doi_key, doi_url, find_doi, normalize_pages, pages_equivalent, parse_arxiv_id, parse_doi, year_from
from recordcheck.functions.latex import strip_markup
from recordcheck.functions.sql import register_functions
from recordcheck.functions.text import STOPWORDS, correction_marker, datacite_words, dblp_words, edit_similarity, line_of, normalized, normalized_document, query_words, title_similarity, token_similarity, words
from recordcheck.functions.titles import base_key, detect_terms, suffixed_keys, wrapped
from recordcheck.functions.urls import classify_url, plain_url_problem, url_problem
from recordcheck.functions.venue import is_preprint_venue, venue_abbreviation, venue_acronyms, venue_field, venue_initialisms, venue_keys, venue_similarity
from recordcheck.operators.checks import page_metadata, url_check
from recordcheck.plans.registry import LETTERS, letters, query, table, text
from recordcheck.sources.settings import last_settings

_FOLD = "trim(regexp_replace(regexp_replace(replace(lower(strip_accents(regexp_replace({}, '[${{}}]', '', 'g'))), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_FOLD.format('text')} AS norm FROM documents")
def fold_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalized_document("text").alias("norm"))


@query(
    f"""SELECT doc_id, CAST(len(w) AS INTEGER) AS tokens, CAST(len(list_distinct(w)) AS INTEGER) AS distinct_tokens,
    CAST(len(list_filter(w, lambda x: list_contains([{', '.join(f"'{s}'" for s in STOPWORDS)}], x))) AS INTEGER) AS stopwords
    FROM (SELECT doc_id, list_filter(string_split({_FOLD.format('text')}, ' '), lambda x: x <> '') AS w FROM documents)"""
)
def token_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", normalized_document("text").alias("norm")).select("doc_id", words("norm").alias("w"))
    stop = F.filter("w", lambda x: x.isin(*STOPWORDS))
    return rows.select("doc_id", F.size("w").alias("tokens"), F.size(F.array_distinct("w")).alias("distinct_tokens"), F.size(stop).alias("stopwords"))


def _name_pairs(spark, sf_dir):
    """Distinct names that share a word, each pair once."""
    names = table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.explode(F.split("p_name", " ")).alias("w"))
    return names.join(names.select(F.col("p_name").alias("other"), "w"), "w").filter("p_name < other").select("p_name", "other").distinct()


_PAIRS = """n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM n),
p AS (SELECT DISTINCT a.p_name, b.p_name AS other FROM w a JOIN w b ON a.w = b.w AND a.p_name < b.p_name),
d AS (SELECT *, CASE WHEN string_split(p_name, ' ')[1] = string_split(other, ' ')[1] OR string_split(p_name, ' ')[2] = string_split(other, ' ')[2] THEN 0.5::DOUBLE ELSE 0.0 END AS dice,
  1 - levenshtein(p_name, other)::DOUBLE / greatest(length(p_name), length(other)) AS edit FROM p)"""


@query(f"WITH {_PAIRS} SELECT p_name, other, round(dice, 6) AS dice, round(edit, 6) AS edit, round(0.6 * dice + 0.4 * edit, 6) AS similarity FROM d")
def title_pairs(spark, sf_dir):
    a, b = F.col("p_name"), F.col("other")
    return _name_pairs(spark, sf_dir).select(
        "p_name", "other", F.round(token_similarity(words(a), words(b)), 6).alias("dice"), F.round(edit_similarity(a, b), 6).alias("edit"), F.round(title_similarity(a, b), 6).alias("similarity")
    )


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'erratum' WHEN 1 THEN 'comment' WHEN 3 THEN 'response' END AS notice FROM part")
def correction_markers(spark, sf_dir):
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    title = F.when(k == 0, text("{E}rratum: ", name)).when(k == 1, text(" Comment on ", name)).when(k == 2, text("Commenting on ", name)).when(k == 3, text("Response formats of ", name)).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", correction_marker(title).alias("notice"))


@query(
    f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN 'Org ' || x ELSE CASE c_custkey % 4 WHEN 2 THEN 'van der ' ELSE '' END || x END AS family,
    CASE c_custkey % 4 WHEN 0 THEN 'Ann B.' WHEN 1 THEN 'Ann' WHEN 2 THEN 'Ann' ELSE '' END AS given, CASE WHEN c_custkey % 4 = 3 THEN 'Org ' || x END AS literal FROM (SELECT *, {LETTERS.format('c_custkey')} AS x FROM customer)"""
)
def author_parse(spark, sf_dir):
    k, x = F.col("c_custkey") % 4, letters(F.col("c_custkey"))
    raw = F.when(k == 0, text(x, ", Jr., Ann B.")).when(k == 1, text("Ann ", x)).when(k == 2, text("Ann van der ", x)).otherwise(text("{Org ", x, "}"))
    return table(spark, sf_dir, "customer").select("c_custkey", parse_author(raw).alias("a")).select("c_custkey", "a.*")


@query(
    f"""SELECT n_nationkey, CAST(count(s_suppkey) AS INTEGER) AS n, n_nationkey % 2 = 0 AS truncated, string_agg({LETTERS.format('s_suppkey')} || ', Jo', ' and ' ORDER BY s_suppkey) AS listed
    FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey"""
)
def author_lists(spark, sf_dir):
    """Suppliers of a nation as an author field, parsed and written again."""
    names = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_suppkey")).alias("keys"))
    raw = F.array_join(F.transform("keys", lambda k: F.concat(F.lit("Jo "), F.translate(k.cast("string"), "0123456789", "abcdefghij"))), "  and\n")
    cut = F.when(F.col("s_nationkey") % 2 == 0, " and others").otherwise("")
    rows = names.select("s_nationkey", parse_authors(text(raw, cut)).alias("p"))
    return rows.select(F.col("s_nationkey").alias("n_nationkey"), F.size("p.authors").alias("n"), "p.truncated", formatted_authors(F.col("p.authors")).alias("listed"))


@query(
    """SELECT s_suppkey, round(CASE s_suppkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 ELSE 0.25 END, 6)::DOUBLE AS score, s_suppkey % 5 IN (0, 1, 2, 3) AS first_match,
    CASE s_suppkey % 5 WHEN 4 THEN 0.0 ELSE 1.0 END::DOUBLE AS overlap FROM supplier"""
)
def author_compare(spark, sf_dir):
    k, x = F.col("s_suppkey") % 5, letters(F.col("s_suppkey"))
    one = text("Ann smith", x)
    other = F.when(k == 0, text("smith", x, ", A.")).when(k == 1, text("smith", x)).when(k == 2, text("smith", x, ", Ann and Other, Zed")).when(k == 3, text("Ann smith", x, " and Other, Zed")).otherwise(text("smith", x, ", Bob"))
    given = F.when(k == 3, text(one, " and others")).otherwise(one)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", parse_authors(given).alias("a"), parse_authors(other).alias("b"))
    rows = rows.withColumn("c", compare_authors(F.col("a.authors"), F.col("b.authors"), F.col("a.truncated")))
    return rows.select("s_suppkey", F.round("c.score", 6).alias("score"), "c.first_match", "c.overlap")


def _doi_spelling():
    key = F.col("p_partkey")
    forms = [text("10.5555/P", key), text("doi: 10.5555/p", key, "."), text("https://doi.org/10.5555/p", key), text("http://dx.doi.org/10.5555%2Fp", key), text("{10.5555/p}", key, ",;"), text("11.5555/p", key), text("10.55/p", key)]
    out = F.lit(None).cast("string")
    for n, form in enumerate(forms):
        out = F.when(key % len(forms) == n, form).otherwise(out)
    return out


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '10.5555/P' || p_partkey WHEN p_partkey % 7 < 5 THEN '10.5555/p' || p_partkey END AS doi, CASE WHEN p_partkey % 7 < 5 THEN 'https://doi.org/10.5555/p' || p_partkey END AS url FROM part")
def doi_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", parse_doi(_doi_spelling()).alias("doi"))
    return rows.select("p_partkey", "doi", doi_url(F.lower("doi")).alias("url"))


@query("SELECT p_partkey, l_orderkey, l_linenumber FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_partkey % 7 < 5")
def doi_same_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", doi_key(_doi_spelling()).alias("doi")).filter("doi IS NOT NULL")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", doi_key(text("https://DOI.org/10.5555/p", F.col("l_partkey")), decoded=False).alias("doi"))
    return lines.join(parts, "doi").select("p_partkey", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN '10.1234/o' || o_orderkey END AS doi FROM orders")
def doi_in_text(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, text("see <10.1234/o", k, ">.")).when(k % 3 == 1, text('href="https://doi.org/10.1234/o', k, '." and 10.9/x')).otherwise(text("version 10.1 of /o", k))
    return table(spark, sf_dir, "orders").select("o_orderkey", find_doi(said, decoded=False).alias("doi"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN y || '.' || n || 'v2' WHEN 1 THEN y || '.' || n WHEN 2 THEN 'cs/' || lpad(o_orderkey::VARCHAR, 7, '0') END AS arxiv_id FROM (SELECT o_orderkey, '2' || lpad((o_orderkey % 12 + 1)::VARCHAR, 3, '4') AS y, lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS n FROM orders)")
def arxiv_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    modern = text("2", F.lpad((k % 12 + 1).cast("string"), 3, "4"), ".", F.lpad((k % 100000).cast("string"), 5, "0"))
    raw = F.when(k % 4 == 0, text("arXiv: ", modern, "v2")).when(k % 4 == 1, text("https://www.arxiv.org/pdf/", modern, ".PDF")).when(k % 4 == 2, text("cs/", F.lpad(k.cast("string"), 7, "0"))).otherwise(text(modern, " [cs]"))
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_arxiv_id(raw).alias("arxiv_id"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 4 = 3 THEN 'e' || a || ', ' || b ELSE a || '--' || b END AS pages, l_linenumber % 4 < 3 AS same
    FROM (SELECT *, 1000 + l_partkey AS a, 1000 + l_partkey + l_suppkey AS b FROM lineitem)""")
def pages_ranges(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    a, b = F.col("l_partkey") + 1000, F.col("l_partkey") + F.col("l_suppkey") + 1000
    raw = F.when(k == 0, text(a, " – ", b)).when(k == 1, text(a, "-", b)).when(k == 2, text(" ", a, "---", b, " ")).otherwise(text("e", a, ",  ", b))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", normalize_pages(raw).alias("pages"), pages_equivalent(raw, text(a, "--", b)).alias("same"))


@query("SELECT p_partkey, true AS same FROM part")
def pages_abbreviated(spark, sf_dir):
    """An end without the digits that it shares with the begin."""
    a = F.col("p_partkey") * 100 + 100011
    return table(spark, sf_dir, "part").select("p_partkey", pages_equivalent(text(a, "-", (a + 8) % 100), text(a, "--", a + 8)).alias("same"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN -1 ELSE year(o_orderdate)::INTEGER END AS year FROM orders")
def years(spark, sf_dir):
    k, date = F.col("o_orderkey") % 3, F.col("o_orderdate").cast("string")
    raw = F.when(k == 0, date).when(k == 1, F.substring(date, 1, 4)).otherwise(text("in ", date))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(year_from(raw), F.lit(-1)).alias("year"))


_VENUES = (
    ("CHI", "Proceedings of the 2024 CHI Conference on Human Factors in Computing Systems", 0.9), ("CCS", "ACM Conference on Computer and Communications Security", 0.9),
    ("Proc. of the International Conference on Machine Learning", "Intl. Conf. on Machine Learning", 1.0), ("arXiv preprint", "CoRR", 1.0), ("Journal of Data", "Nature", 0.0),
    ("Commun. ACM", "Communications of the ACM", 0.85), ("Journal", "Proceedings", 1.0), ("Journal of Data Mining", "Data Warehousing and Mining", 0.85),
)


@query("SELECT a, b, round(s, 6)::DOUBLE AS similarity FROM (VALUES " + ", ".join(f"('{a}', '{b}', {s})" for a, b, s in _VENUES) + ") AS v(a, b, s)")
def venue_pairs(spark, sf_dir):
    """Fixed pairs: acronyms, initialisms, noise words, abbreviations."""
    rows = spark.createDataFrame([v[:2] for v in _VENUES], "a string, b string").withColumns({"x": venue_keys("a"), "y": venue_keys("b")})
    return rows.select("a", "b", F.round(venue_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("SELECT n_nationkey, 'chi,s' || x || 'x' AS acronyms, 'hfcs' AS initialism, 'chi' AS label, 'booktitle' AS field, n_nationkey % 2 = 0 AS preprint FROM (SELECT n_nationkey, lower(" + LETTERS.format("n_nationkey") + ") AS x FROM nation)")
def venue_names(spark, sf_dir):
    x = F.upper(letters(F.col("n_nationkey")))
    venue = text("Proc. of (CHI '24) and S", x, "X of the ACM")
    place = F.when(F.col("n_nationkey") % 2 == 0, "bioRxiv (preprint)").otherwise("Corridor Press")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", F.array_join(venue_acronyms(venue), ",").alias("acronyms"), F.array_join(venue_initialisms(F.lit("human factors in computing systems")), ",").alias("initialism"),
        venue_abbreviation(venue, F.lit("")).alias("label"), venue_field(F.lit("Conference")).alias("field"), is_preprint_venue(place).alias("preprint"),
    )


@query("""SELECT p_partkey, u.t AS term, u.k AS kind, replace(p_name || ' with GPT-4, IoT and 5G for Python in {AI} $X$', u.t, '{' || u.t || '}') AS wrapped
    FROM part, LATERAL (SELECT * FROM (VALUES ('GPT', 'acronym'), ('IoT', 'mixed-case'), ('5G', 'acronym'), ('Python', 'proper-name')) AS v(t, k)) AS u""")
def protect_terms(spark, sf_dir):
    title = text(F.col("p_name"), " with GPT-4, IoT and 5G for Python in {AI} $X$")
    rows = table(spark, sf_dir, "part").select("p_partkey", title.alias("title")).select("p_partkey", "title", F.explode(detect_terms("title")).alias("t"))
    return rows.select("p_partkey", "t.term", "t.kind", wrapped("title", F.col("t.term")).alias("wrapped"))


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN base WHEN n <= 27 THEN base || '_' || chr(CAST(95 + n AS INTEGER)) END AS key FROM (
    SELECT p_partkey, base, row_number() OVER (PARTITION BY p_brand, base ORDER BY p_partkey) AS n FROM (
      SELECT p_partkey, p_brand, 'dupont_' || (1950 + p_size) || '_' || CASE WHEN split_part(p_name, ' ', 1) = 'new' THEN split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) END || '_chi' AS base FROM part))""")
def cite_keys(spark, sf_dir):
    """All keys of a file made anew: repeats get a letter."""
    from pyspark.sql import Window

    base = base_key(F.lit("Du Pont"), F.col("p_size") + 1950, text("The ", F.col("p_name")), venue_abbreviation(F.lit("CHI"), F.lit(None).cast("string")))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", base.alias("base"))
    place = F.row_number().over(Window.partitionBy("p_brand", "base").orderBy("p_partkey"))
    return rows.select("p_partkey", suffixed_keys(F.col("base"), place).alias("key"))


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'URLs containing credentials are not fetched.' WHEN 2 THEN 'Private or reserved IP addresses are not fetched.'
    WHEN 3 THEN 'Local network addresses are not fetched.' WHEN 4 THEN 'The ftp: scheme is not allowed.' WHEN 5 THEN 'Port 22 is not fetched.' WHEN 6 THEN 'Private or reserved IPv6 addresses are not fetched.' ELSE 'Single-label hostnames are not fetched.' END AS problem, NULL::VARCHAR AS plain FROM pages""")
def url_safety(spark, sf_dir):
    """Pages' own URLs are safe; others are made unsafe in a way that depends on the id."""
    k = F.col("page_id") % 8
    made = [F.col("url"), text("https://u:p@x.org/", F.col("page_id")), text("http://0x7f.", F.col("page_id") % 200), F.lit("http://printer.local./"), F.lit("ftp://x.org"), F.lit("https://x.org:22"), F.lit("http://[fe80::1]/"), F.lit("https://intranet/x")]
    url = F.lit(None).cast("string")
    for n, m in enumerate(made):
        url = F.when(k == n, m).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", url_problem(url).alias("problem"), plain_url_problem("url").alias("plain"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'doi' WHEN 1 THEN 'arxiv' ELSE 'web' END AS kind, CASE page_id % 3 WHEN 0 THEN '10.5555/' || page_id WHEN 1 THEN '2401.' || lpad((page_id % 100000)::VARCHAR, 5, '0') END AS id FROM pages")
def url_kinds(spark, sf_dir):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, text("https://DX.doi.org/10.5555/", k)).when(k % 3 == 1, text("https://arxiv.org/abs/2401.", F.lpad((k % 100000).cast("string"), 5, "0"), "v3")).otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", classify_url(F.when(k % 3 == 0, F.replace(url, F.lit("DX"), F.lit("dx"))).otherwise(url)).alias("u"))
    return rows.select("page_id", "u.kind", "u.id")


_TITLE = "trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?i)<title[^>]*>([^<]{1,1000})</title>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Declared ' || page_id ELSE {_TITLE} END AS title, CASE WHEN page_id % 2 = 0 THEN '10.5555/g' || page_id END AS doi FROM pages")
def page_meta(spark, sf_dir):
    """Pages with and without scholarly metadata."""
    k = F.col("page_id")
    tags = text('<META property="og:title" content="x"><meta content=\'Declared ', k, "' name='Citation_Title'><meta name=\"citation_doi\" content=\"doi:10.5555/g", k, '"/>')
    html = F.when(k % 2 == 0, F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), tags))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", page_metadata(html, decoded=False).alias("m")).select("page_id", "m.*")


@query(f"""SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'UNREACHABLE' WHEN page_id % 9 = 1 THEN 'UNVERIFIED' WHEN page_id % 9 = 2 THEN 'UNREACHABLE' WHEN page_id % 9 = 3 THEN 'NOT CHECKED' WHEN page_id % 9 = 4 THEN 'CONFLICT'
    WHEN page_id % 9 = 5 THEN 'UNVERIFIED' WHEN page_id % 9 = 6 THEN 'VERIFIED' WHEN page_id % 9 = 7 THEN 'CONFLICT' ELSE 'HIGH CONFIDENCE' END AS state FROM pages""")
def page_url_state(spark, sf_dir):
    """What pages say of a citation: gone, refusing, failing, offline, redirected, no text, same DOI, other DOI, same title."""
    k = F.col("page_id") % 9
    doi_tag = F.when(k == 6, '<meta name="citation_doi" content="10.5555/same">').when(k == 7, '<meta name="citation_doi" content="10.5555/other">').otherwise("")
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("citation_id"), "url", F.when(k == 4, "http://10.0.0.1/").otherwise(F.col("url")).alias("final_url"),
        F.when(k == 0, 404).when(k == 1, 403).when(k == 2, 503).when(k == 3, F.lit(None)).otherwise(200).cast("int").alias("http"), (k == 3).alias("offline"), (k == 4).alias("redirected"),
        F.when(k == 5, "application/pdf").otherwise("text/html").alias("content_type"), text(doi_tag, F.col("html")).alias("body"),
        F.when(k >= 6, strip_markup(F.regexp_extract("html", "<title>([^<]*)</title>", 1))).alias("cited_title"), F.when(k < 8, "10.5555/SAME").alias("cited_doi"),
    )
    return url_check(rows).select(F.col("citation_id").alias("page_id"), "state")


@query("SELECT p_partkey, p_name || ' a b' AS query, 3 AS line FROM part")
def title_queries(spark, sf_dir):
    name = F.col("p_name")
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", query_words(text("{", name, "}: \\'a!  b $c$"), F.lit(4)).alias("query"), line_of(text(name, "\n\n", name), F.char_length(name) + 4).cast("int").alias("line"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    """WITH p AS (SELECT p_partkey, p_name AS a, p_name || ' study' AS b, p_type, p_size FROM part)
    SELECT p_partkey, round(0.6 * 2 * len(string_split(a, ' ')) / (len(string_split(a, ' ')) + len(string_split(b, ' '))) + 0.4 * (1 - levenshtein(a, b)::DOUBLE / length(b)), 9) AS title,
    CASE WHEN p_partkey % 3 < 2 THEN '10.5555/p' || p_partkey END AS doi, p_size || '--' || (p_size + 100) AS pages, p_partkey % 2 = 0 AS same_pages, CAST(1950 + p_size AS INTEGER) AS year,
    CASE WHEN p_partkey % 2 = 0 THEN '2401.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') END AS arxiv, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END::DOUBLE AS venue FROM p"""
)
def sql_functions(spark, sf_dir):
    """Titles, DOIs, pages, years, arXiv ids and venues in plain SQL, by the registered functions."""
    register_functions(spark)
    return spark.sql(
        """SELECT p_partkey, round(title_similarity(normalize_text(concat('{{', upper(p_name), '}}')), normalize_text(concat(p_name, '-Study'))), 9) AS title,
        parse_doi(CASE p_partkey % 3 WHEN 0 THEN concat('https://doi.org/10.5555%2Fp', p_partkey) WHEN 1 THEN concat('doi: {{10.5555/p', p_partkey, '}}.') ELSE concat('10.55/', p_partkey) END) AS doi,
        normalize_pages(concat(p_size, ' – ', p_size + 100)) AS pages, pages_equivalent(concat(p_size + 1000, '-', p_size + 1000), concat(p_size + 1000, '--', right(p_size + 1000 + p_partkey % 2, 2))) AS same_pages,
        year_from(concat(1950 + p_size, '-05-01')) AS year, parse_arxiv_id(CASE WHEN p_partkey % 2 = 0 THEN concat('arXiv:2401.', lpad(p_partkey % 100000, 5, '0')) ELSE 'none' END) AS arxiv,
        venue_similarity(concat('Proceedings of the ', p_type), CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE 'zzz' END) AS venue FROM {part}""",
        part=table(spark, sf_dir, "part"),
    )


@query(
    """WITH l AS (SELECT user_id, arg_max(event_id, (epoch_us(ts), event_id)) AS e, arg_max(event_type, (epoch_us(ts), event_id)) AS t FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN t = 'error' THEN 'verify' ELSE 'clean' END AS mode, CASE WHEN e % 7 = 0 THEN 30 ELSE least(365, greatest(0, e % 1000 - 100)) END::DOUBLE AS days,
    CASE e % 3 WHEN 0 THEN '-' WHEN 1 THEN '_' ELSE ':' END AS separator, CASE WHEN e % 2 = 0 THEN 'a@b.org' ELSE '' END AS email, CASE WHEN e % 5 = 0 THEN 'year,author' ELSE 'author,year,keyword,venue' END AS parts FROM l"""
)
def settings_loaded(spark, sf_dir):
    """Events as saved settings: a user's last ones count, numbers are clamped, what is not valid falls back to its default."""
    e = F.col("event_id")
    days = F.when(e % 7 == 0, F.lit(None)).otherwise(e % 1000 - 100)
    parts = F.when(e % 5 == 0, F.array(F.lit("year"), F.lit("author"), F.lit("year"))).otherwise(F.array(F.lit("year"), F.lit("colour")))
    scheme = F.struct(F.when(e % 3 == 0, "-").when(e % 3 == 1, "**").otherwise(":").alias("separator"), parts.alias("parts"))
    raw = F.to_json(F.struct(F.when(F.col("event_type") == "error", "verify").otherwise("other").alias("mode"), days.alias("found_ttl_days"), scheme.alias("key_scheme"), F.when(e % 2 == 0, " a@b.org ").otherwise("nobody").alias("contact_email")))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.struct("ts", "event_id").alias("saved_at"), raw.alias("raw"))
    s = last_settings(log).select("user", "settings.*")
    return s.select(F.col("user").alias("user_id"), "mode", F.col("found_ttl_days").alias("days"), "key_scheme.separator", F.col("contact_email").alias("email"), F.array_join("key_scheme.parts", ",").alias("parts"))


@query(
    """SELECT p_partkey, 'study ' || p_name || ' no' || p_partkey || ' Cafe one two three four five' AS dblp, 'A study ' || p_name || ' no' || p_partkey || ' b Cafe one two three four five six' AS datacite FROM part"""
)
def search_words(spark, sf_dir):
    """The words that services are asked with: ten whole words for one, no signs of a search syntax for another."""
    title = text("{A} study: ", F.col("p_name"), " no", F.col("p_partkey"), " (b) Caf\\'e")
    asked = query_words(text(title, " one-two three four five six"), F.lit(20))
    return table(spark, sf_dir, "part").select("p_partkey", dblp_words(asked).alias("dblp"), datacite_words(asked).alias("datacite"))
