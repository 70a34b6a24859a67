"""Queries over evaluation, review, patches and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordcheck.config import Settings
from recordcheck.operators.apply import apply_suggestions, diff_text, line_diff, tidy_layout
from recordcheck.operators.citations import build_citations
from recordcheck.operators.evaluate import comparison_rows, evaluate, suggestion_rows
from recordcheck.operators.metrics import calibration, judge, report, wrong_with_high_confidence
from recordcheck.operators.review import accept_all, by_section, carry_decisions, counts, decide, line_marks, set_version_changes
from recordcheck.operators.score import scored, work_keys
from recordcheck.operators.trials import trials, violations
from recordcheck.plans.queries_bibtex import part_entry
from recordcheck.plans.queries_match import from_source, person, work
from recordcheck.plans.registry import query, table, text
from recordcheck.schema import CHECK
from recordcheck.sources.bibtex import entries, fields, items
from recordcheck.storage import stored


def _off_entry():
    """An entry of a part, every second one with a wrong year."""
    key = F.col("p_partkey")
    return text("@article{k", key, ",\n  title = {", F.col("p_name"), " in Python},\n  author = {Jo Doe},\n  journal = {Journal of ", F.col("p_type"), "},\n  year = {", F.col("p_size") + 1950 + key % 2, "},\n  pages = {1-9}\n}")


def _evaluated(spark, sf_dir: str, mode: str = "clean"):
    """Each part as an entry with a wrong year, pages with a hyphen and no DOI, against its record."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    year = F.col("p_size") + 1950
    parsed = stored(items(part.select("p_partkey", _off_entry().alias("text")), "p_partkey"), "parsed")
    cited = build_citations(entries(parsed), fields(parsed))
    record = work(
        title=text(F.col("p_name"), " in Python"), authors=F.array(person(F.lit("Doe"), "Jo")), year=year, venue=text("Journal of ", F.col("p_type")), pages=F.lit("1--9"), doi=text("10.5555/", key),
        type=F.lit("article"), volume=F.lit("4"), sources=from_source("Crossref"),
    )
    pairs = cited.join(part.select(key.alias("file_id"), record.alias("rec")).hint("merge"), "file_id")
    pairs = scored(work_keys(work_keys(pairs, "work", "a"), "rec", "b"), "a", "b", "authors_truncated")
    cand = F.struct(F.col("rec").alias("work"), F.array("rec").alias("records"), "score")
    ready = pairs.withColumns({"cand": cand, "doi_checks": F.array().cast(f"array<{CHECK}>"), "url_check": F.lit(None).cast("struct<state:string,label:string,detail:string,final_url:string,page_title:string>"), "existing_keys": F.array("key")})
    return evaluate(ready, Settings(mode=mode))


@query(
    """SELECT p_partkey, u.f AS field, u.s AS status FROM part, LATERAL (SELECT * FROM (VALUES ('entry type', 'VERIFIED'), ('title', 'VERIFIED'), ('author', 'VERIFIED'),
      ('year', CASE WHEN p_partkey % 2 = 0 THEN 'VERIFIED' ELSE 'CONFLICT' END), ('journal', 'VERIFIED'), ('volume', 'MISSING'), ('pages', 'VERIFIED'), ('doi', 'MISSING')) AS v(f, s)) AS u"""
)
def field_status(spark, sf_dir):
    rows = comparison_rows(_evaluated(spark, sf_dir))
    return rows.select(F.split("citation_id", ":")[0].cast("bigint").alias("p_partkey"), "field", "status")


_SUGGESTED = """SELECT p_partkey, u.f AS field, u.o AS operation, u.c AS category, u.s AS suggested, u.k AS confidence FROM part, LATERAL (SELECT * FROM (VALUES
  ('title', 'format', 'format', '{Python}', 'POSSIBLE'), ('year', 'replace', 'conflict', (1950 + p_size)::VARCHAR, 'VERY HIGH'), ('volume', 'add', 'missing', '4', 'VERY HIGH'), ('doi', 'add', 'missing', '10.5555/' || p_partkey, 'VERY HIGH'),
  ('url', 'add', 'format', 'https://doi.org/10.5555/' || p_partkey, 'VERY HIGH'), ('pages', 'format', 'format', '1--9', 'VERY HIGH'),
  ('KEY', 'replace', 'key', 'doe_' || (1950 + p_size) || '_' || CASE WHEN p_name LIKE 'new %' THEN split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) END || '_' || lower(p_type), 'HIGH'),
  ('ENTRY', 'format', 'format', 'Aligned fields, braces instead of quotes, standard field order', 'VERY HIGH')) AS v(f, o, c, s, k)) AS u WHERE (u.f <> 'year' OR p_partkey % 2 = 1)"""


@query(_SUGGESTED)
def suggestions(spark, sf_dir):
    rows = suggestion_rows(_evaluated(spark, sf_dir))
    return rows.select(F.split("citation_id", ":")[0].cast("bigint").alias("p_partkey"), "field", "operation", "category", "suggested", "confidence")


@query(_SUGGESTED.replace("WHERE (", "WHERE u.c = 'conflict' AND ("))
def verify_mode(spark, sf_dir):
    """Corrections only."""
    rows = suggestion_rows(_evaluated(spark, sf_dir, "verify"))
    return rows.select(F.split("citation_id", ":")[0].cast("bigint").alias("p_partkey"), "field", "operation", "category", "suggested", "confidence")


# ---- review ----
def _suggestions(spark, sf_dir: str):
    """Line items of an order as suggestions: groups by line number, decisions by return flag."""
    n = F.col("l_linenumber")
    accepted = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    category = F.when(n % 5 == 0, "key").when(n % 5 == 1, "version").when(n % 5 == 2, "missing").otherwise("conflict")
    rows = table(spark, sf_dir, "lineitem").withColumn("ordinal", (F.col("l_partkey") * 1000 + F.col("l_suppkey")) * 8 + n)
    return rows.select(
        F.col("l_orderkey").alias("citation_id"), "ordinal", F.col("ordinal").cast("string").alias("id"), text("f", n).alias("field"), F.lit("set").alias("kind"), F.col("l_partkey").cast("string").alias("suggested"),
        category.alias("category"), F.when(n % 4 > 0, text("g", n % 4)).alias("grp"), accepted.alias("accepted"),
    )


_S = """s AS (SELECT l_orderkey AS c, (l_partkey * 1000 + l_suppkey) * 8 + l_linenumber AS o, l_linenumber AS n, l_partkey,
  CASE l_linenumber % 5 WHEN 0 THEN 'key' WHEN 1 THEN 'version' WHEN 2 THEN 'missing' ELSE 'conflict' END AS category, CASE WHEN l_linenumber % 4 > 0 THEN 'g' || (l_linenumber % 4) END AS grp,
  CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS a FROM lineitem)"""


def _decided(rows):
    state = F.when(F.col("accepted").isNull(), "open").when(F.col("accepted"), "yes").otherwise("no")
    return rows.groupBy("citation_id", state.alias("state")).agg(F.count("*").alias("n"), F.sum("ordinal").alias("ordinals"))


_DECIDED = "SELECT c AS citation_id, CASE WHEN b IS NULL THEN 'open' WHEN b THEN 'yes' ELSE 'no' END AS state, count(*) AS n, sum(o)::BIGINT AS ordinals FROM d GROUP BY ALL"


@query(f"""WITH {_S}, t AS (SELECT c, min(o) AS o FROM s GROUP BY c), x AS (SELECT t.c, t.o, s.grp FROM t JOIN s ON t.c = s.c AND t.o = s.o),
  d AS (SELECT s.c, s.o, CASE WHEN s.o = x.o THEN true WHEN s.grp = x.grp AND s.a THEN false ELSE s.a END AS b FROM s JOIN x ON s.c = x.c) {_DECIDED}""")
def review_decide(spark, sf_dir):
    """The first suggestion of each citation is accepted."""
    rows = _suggestions(spark, sf_dir)
    first = rows.groupBy("citation_id").agg(F.min_by("id", "ordinal").alias("id")).withColumn("decision", F.lit(True))
    return _decided(decide(rows, first))


@query(f"""WITH {_S}, g AS (SELECT *, coalesce(grp, '#' || o) AS k FROM s), h AS (SELECT *, bool_or(coalesce(a, false)) OVER (PARTITION BY c, k) AS taken, min(CASE WHEN a IS NULL AND category NOT IN ('key', 'version') THEN o END) OVER (PARTITION BY c, k) AS f FROM g),
  d AS (SELECT c, o, CASE WHEN a IS NULL AND category NOT IN ('key', 'version') AND (grp IS NULL OR (NOT taken AND o = f)) THEN true ELSE a END AS b FROM h) {_DECIDED}""")
def review_accept_all(spark, sf_dir):
    return _decided(accept_all(_suggestions(spark, sf_dir)))


@query(f"""WITH {_S}, v AS (SELECT *, max(CASE WHEN category = 'version' THEN o END) OVER (PARTITION BY c, grp) AS l FROM s),
  d AS (SELECT c, o, CASE WHEN category = 'version' AND (grp IS NULL OR o = l) THEN true WHEN grp IS NOT NULL AND l IS NOT NULL AND (category = 'version' OR a) THEN false ELSE a END AS b FROM v) {_DECIDED}""")
def review_versions(spark, sf_dir):
    return _decided(set_version_changes(_suggestions(spark, sf_dir), True))


@query(f"WITH {_S}, k AS (SELECT c, n, l_partkey, arg_max(a, o) AS a FROM s WHERE a IS NOT NULL GROUP BY ALL), d AS (SELECT s.c, s.o, k.a AS b FROM s LEFT JOIN k ON s.c = k.c AND s.n = k.n AND s.l_partkey = k.l_partkey) {_DECIDED}")
def review_carry(spark, sf_dir):
    """Decisions carried to suggestions made anew."""
    rows = _suggestions(spark, sf_dir)
    return _decided(carry_decisions(rows, rows.withColumn("accepted", F.lit(None).cast("boolean"))))


@query(f"WITH {_S} SELECT c AS citation_id, count(*) AS total, count(*) FILTER (WHERE a) AS accepted_n, count(*) FILTER (WHERE NOT a) AS rejected_n, count(*) FILTER (WHERE a IS NULL) AS undecided_n FROM s GROUP BY c")
def review_counts(spark, sf_dir):
    return counts(_suggestions(spark, sf_dir))


@query(f"WITH {_S} SELECT CAST(CASE category WHEN 'conflict' THEN 0 WHEN 'version' THEN 1 WHEN 'missing' THEN 2 ELSE 5 END AS INTEGER) AS section_place, CASE category WHEN 'conflict' THEN 'Corrections' WHEN 'version' THEN 'Published version' WHEN 'missing' THEN 'Missing information' ELSE 'Citation key' END AS section, count(*) AS n FROM s GROUP BY ALL")
def review_sections(spark, sf_dir):
    return by_section(_suggestions(spark, sf_dir)).groupBy("section_place", "section").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS citation_id, l_linenumber AS line, CASE min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) WHEN 1 THEN 'bad' WHEN 2 THEN 'info' ELSE 'good' END AS mark FROM lineitem GROUP BY ALL")
def proof_marks(spark, sf_dir):
    flag = F.col("l_returnflag")
    mark = F.when(flag == "A", "bad").when(flag == "N", "info").otherwise("good")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citation_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("ordinal"), mark.alias("mark"))
    return line_marks(rows)


# ---- patches ----
def _changes(part, *changes):
    """A few changes (field, kind, value, term, to) to every part's entry."""
    none = F.lit(None).cast("string")
    of = lambda x: none if x is None else x if not isinstance(x, str) else F.lit(x)
    rows = F.array(*[F.struct(F.lit(n).alias("ordinal"), F.lit(f"s{n}").alias("id"), *[of(v).alias(name) for name, v in zip(("field", "kind", "value", "term", "to"), c)]) for n, c in enumerate(changes)])
    return part.select(F.col("p_partkey").alias("citation_id"), F.explode(rows).alias("c")).select("citation_id", "c.*", F.lit(True).alias("accepted"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN e ELSE '@article{p' || p_partkey || E',\\n  title = {{Big} ' || p_name || E'},\\n  year = 2001,\\n  booktitle = {' || p_type || '} # " line",' || E'\\n  doi = {10.5555/' || p_partkey || E'}\\n}\\n' END AS result,
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 's0,s1,s2,s3,s5,s4' END AS applied, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 's6' END AS skipped FROM (
      SELECT *, '@book{p' || p_partkey || E',\\n  title = {' || p_name || E'},\\n  publisher = "' || p_brand || E'",\\n  year = ' || (1950 + p_size) || E',\\n  series = {' || p_type || E'} # " line"\\n}\\n' AS e FROM part)"""
)
def apply_patch(spark, sf_dir):
    """Minimal edits: type, title, year, a new field, a rename, a removal; a wrap of a macro's field is refused. Every fourth
    entry has nothing accepted and stays as it was."""
    part = table(spark, sf_dir, "part")
    made = _changes(
        part, ("ENTRYTYPE", "set", "article", None, None), ("title", "set", text("Big ", F.col("p_name")), None, None), ("year", "set", "2001", None, None), ("doi", "set", text("10.5555/", F.col("p_partkey")), None, None),
        ("publisher", "remove", None, None, None), ("series", "rename", None, None, "booktitle"), ("series", "wrap", None, "line", None), ("title", "wrap", None, "Big", None),
    )
    some = made.withColumn("accepted", F.when(F.col("citation_id") % 4 > 0, F.col("accepted")))
    rows = apply_suggestions(part.select(F.col("p_partkey").alias("citation_id"), part_entry().alias("text")), some)
    ids = F.filter("applied", lambda i: i != "s7")
    value = F.replace("result", F.lit("year = {2001}"), F.lit("year = 2001"))
    return rows.select(F.col("citation_id").alias("p_partkey"), value.alias("result"), F.array_join(ids, ",").alias("applied"), F.array_join(F.transform("skipped", lambda s: s["id"]), ",").alias("skipped"))


@query("""SELECT p_partkey, '@book{p' || p_partkey || E',\\n  title     = {' || p_name || E'},\\n  series    = {' || p_type || E'} # " line",\\n  year      = ' || (1950 + p_size) || E',\\n  publisher = {' || p_brand || E'}\\n}' AS result FROM part""")
def apply_layout(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tidy_layout(part_entry()).alias("result"))


@query("""SELECT p_partkey, '  @book{p' || p_partkey || E',\\n-   title = {' || p_name || E'},\\n-   publisher = "' || p_brand || E'",\\n-   year = ' || (1950 + p_size) || E',\\n-   series = {' || p_type || E'} # " line"\\n+   title     = {' || p_name || E'},\\n+   series    = {' || p_type || E'} # " line",\\n+   year      = ' || (1950 + p_size) || E',\\n+   publisher = {' || p_brand || E'}\\n  }\\n- ' AS diff FROM part""")
def layout_diff(spark, sf_dir):
    """An entry against its tidied form."""
    rows = table(spark, sf_dir, "part").select("p_partkey", part_entry().alias("a"), tidy_layout(part_entry()).alias("b"))
    return rows.select("p_partkey", diff_text(line_diff("a", "b")).alias("diff"))


@query("""SELECT o_orderkey, CAST(2 AS BIGINT) AS same, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS del, CAST(1 AS BIGINT) AS add FROM orders""")
def line_diff_counts(spark, sf_dir):
    k = F.col("o_orderkey")
    a = text(k, F.when(k % 2 == 0, "\nold").otherwise(""), "\nend")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", line_diff(a, text(k, "\nnew\nend")).alias("d"))
    n = lambda kind: F.size(F.filter("d", lambda x: x["kind"] == kind)).cast("bigint").alias(kind)
    return rows.select("o_orderkey", n("same"), n("del"), n("add"))


def _tried(spark, sf_dir: str):
    """Trials of all suggestions made for parts."""
    texts = table(spark, sf_dir, "part").select(text(F.col("p_partkey"), ":0").alias("citation_id"), _off_entry().alias("text"))
    return trials(texts, stored(suggestion_rows(_evaluated(spark, sf_dir)), "tried-suggestions"), ("trial", "field", "changed"))


@query(
    f"""WITH s AS ({_SUGGESTED}), w AS (SELECT *, CASE WHEN field = 'ENTRY' THEN NULL ELSE field END AS c FROM s),
    e AS (SELECT p_partkey, list_sort(list(c) FILTER (WHERE c IS NOT NULL)) AS every FROM w GROUP BY p_partkey)
    SELECT p_partkey, 'alone' AS trial, field, coalesce(c, '') AS changed FROM w
    UNION ALL SELECT p_partkey, 'without', field, array_to_string(list_filter(every, lambda x: x <> field), ',') FROM w JOIN e USING (p_partkey)
    UNION ALL SELECT p_partkey, 'bulk', NULL, array_to_string(list_filter(every, lambda x: x <> 'KEY'), ',') FROM e
    UNION ALL SELECT p_partkey, 'none', NULL, '' FROM e"""
)
def approval_trials(spark, sf_dir):
    """What changes with each suggestion by itself, with all others, with bulk acceptance, and with all taken back."""
    rows = _tried(spark, sf_dir)
    return rows.select(F.split("citation_id", ":")[0].cast("bigint").alias("p_partkey"), "trial", "field", F.array_join("changed", ",").alias("changed"))


@query(
    """SELECT p_partkey, u.t AS trial, u.i AS id, u.r AS rule FROM part, LATERAL (SELECT * FROM (VALUES ('alone', 's0', 'an accepted suggestion changes nothing'), ('alone', 's2', 'more than its own field changes'),
      ('bulk', NULL, 'bulk acceptance changes the key')) AS v(t, i, r)) AS u WHERE (u.i IS NULL OR u.i <> 's0' OR p_partkey % 2 = 0)"""
)
def approval_violations(spark, sf_dir):
    """Suggestions that set a year to what it was, put a second field into a value, and change the key under another name."""
    part = table(spark, sf_dir, "part")
    year = F.when(F.col("p_partkey") % 2 == 0, text("{", F.col("p_size") + 1950, "}")).otherwise("{1900}")
    entry = text("@book{p", F.col("p_partkey"), ",\n  title = {", F.col("p_name"), "},\n  year = ", year, "\n}\n")
    made = _changes(
        part, ("year", "set", (F.col("p_size") + 1950).cast("string"), None, None), ("note", "set", F.col("p_type"), None, None),
        ("series", "set", "x}, volume = {7", None, None), ("title", "rename", None, None, "subtitle"), ("KEY", "set", "k", None, None),
    )
    made = made.withColumns({"category": F.lit("missing"), "grp": F.lit(None).cast("string")})
    return violations(trials(part.select(F.col("p_partkey").alias("citation_id"), entry.alias("text")), made)).withColumnRenamed("citation_id", "p_partkey")


# ---- metrics ----
def _judged(spark, sf_dir: str):
    """Labels as judged suggestions: toxic as wrong, quality as sure."""
    labels = table(spark, sf_dir, "labels")
    field = F.when(F.col("doc_id") % 3 == 0, "doi").otherwise("year")
    suggested = F.when(F.col("doc_id") % 3 == 0, text("https://doi.org/10.5555/", F.col("doc_id") + F.col("toxic"))).otherwise((F.col("doc_id") % 50 + 1950 + F.col("toxic")).cast("string"))
    s = labels.select(F.col("doc_id").alias("entry_id"), field.alias("field"), F.lit("conflict").alias("category"), F.lit("set").alias("kind"), suggested.alias("suggested"), F.when(F.col("quality") == 1, "HIGH").otherwise("POSSIBLE").alias("confidence"))
    doi = F.when(F.col("doc_id") % 9 > 0, text("10.5555/", F.col("doc_id")))
    none = F.lit(None).cast("string")
    t = labels.select(F.col("doc_id").alias("entry_id"), doi.alias("doi"), (F.col("doc_id") % 7 > 0).alias("doi_known"), none.alias("title"), (F.col("doc_id") % 50 + 1950).cast("int").alias("year"), none.alias("venue"), none.alias("pages"))
    return judge(s, t), t


def _outcomes(spark, sf_dir: str):
    _, truth = _judged(spark, sf_dir)
    k = F.col("entry_id")
    return truth.select(
        "entry_id", (k % 2 == 0).alias("input_had_doi"), "doi", "doi_known", F.when(k % 4 > 0, k % 8 == 1).alias("ambiguous"), (k % 16 == 1).alias("ambiguous_predicted"), F.when(k % 5 > 0, k % 5 < 4).alias("top1"),
        ((k % 41) / 40.0).alias("score"), F.when(k % 20 == 19, "down").alias("error"),
    )


_V = """v AS (SELECT doc_id AS k, doc_id % 3 = 0 AS is_doi, quality = 1 AS sure, CASE WHEN doc_id % 3 > 0 THEN CASE WHEN toxic = 0 THEN 'correct' ELSE 'incorrect' END WHEN doc_id % 7 = 0 THEN 'unjudged' WHEN doc_id % 9 = 0 THEN 'incorrect' WHEN toxic = 0 THEN 'correct' ELSE 'incorrect' END AS verdict FROM labels),
o AS (SELECT doc_id AS k, doc_id % 2 = 0 AS had, doc_id % 9 > 0 AS has, CASE WHEN doc_id % 4 > 0 THEN doc_id % 8 = 1 END AS amb, doc_id % 16 = 1 AS pred, CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 < 4 END AS top1, (doc_id % 41) / 40.0::DOUBLE AS score, doc_id % 20 = 19 AS bad FROM labels)"""


@query(f"WITH {_V} SELECT k AS entry_id, verdict FROM v")
def judged_suggestions(spark, sf_dir):
    return _judged(spark, sf_dir)[0].select("entry_id", "verdict")


@query(
    f"""WITH {_V}, j AS (SELECT v.*, had FROM v JOIN o ON v.k = o.k WHERE NOT bad AND verdict <> 'unjudged'), e AS (SELECT o.*, exists(SELECT 1 FROM j WHERE j.k = o.k AND is_doi AND verdict = 'correct') AS found FROM o WHERE NOT bad),
    r AS (SELECT avg((verdict = 'correct')::INT) FILTER (WHERE is_doi AND NOT had) AS doi_precision, avg((verdict = 'incorrect')::INT) FILTER (WHERE is_doi) AS incorrect_doi_rate, avg((verdict = 'correct')::INT) AS field_precision,
      avg((verdict = 'incorrect')::INT) FILTER (WHERE sure) AS high_confidence_incorrect_rate, count(*) FILTER (WHERE sure AND verdict = 'incorrect') = 0 AS release FROM j),
    q AS (SELECT count(*) AS entries, avg(found::INT) FILTER (WHERE NOT had AND has) AS doi_recall, avg(top1::INT) AS top1_accuracy, avg((amb = pred)::INT) AS ambiguity_accuracy FROM e)
    SELECT entries, (SELECT count(*) FROM o WHERE bad) AS errors, round(doi_precision, 9) AS doi_precision, round(doi_recall, 9) AS doi_recall, round(incorrect_doi_rate, 9) AS incorrect_doi_rate, round(field_precision, 9) AS field_precision, round(top1_accuracy, 9) AS top1_accuracy,
      round(ambiguity_accuracy, 9) AS ambiguity_accuracy, round(high_confidence_incorrect_rate, 9) AS high_confidence_incorrect_rate, release FROM r, q"""
)
def precision_recall(spark, sf_dir):
    r = report(_outcomes(spark, sf_dir), _judged(spark, sf_dir)[0])
    return r.select(*[F.round(c, 9).alias(c) if c not in ("entries", "errors", "release") else c for c in r.columns])


@query(f"WITH {_V} SELECT t::DOUBLE AS threshold, count(k) AS n, round(avg(top1::INT), 9) AS precision FROM (VALUES (0.7), (0.8), (0.85), (0.9), (0.95), (0.97)) AS x(t) LEFT JOIN o ON top1 IS NOT NULL AND score >= t::DOUBLE GROUP BY t")
def calibration_table(spark, sf_dir):
    return calibration(_outcomes(spark, sf_dir)).withColumn("precision", F.round("precision", 9))


@query(f"WITH {_V} SELECT k AS entry_id FROM v WHERE sure AND verdict = 'incorrect'")
def release_gate(spark, sf_dir):
    return wrong_with_high_confidence(_judged(spark, sf_dir)[0]).select("entry_id")
