"""Parsed entries to citations: plain field values and the work they describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordcheck.functions.authors import parse_authors
from recordcheck.functions.binding import bound
from recordcheck.functions.identifiers import ARXIV_DOI, arxiv_mention, find_doi, parse_arxiv_id, parse_doi
from recordcheck.functions.latex import decode_latex
from recordcheck.functions.venue import is_preprint_venue, normalize_type
from recordcheck.schema import WORK, WORK_FIELDS
from recordcheck.sources.bibtex import inherited_fields
from recordcheck.storage import stored

_NAMED = "array<struct<name:string,text:string>>"


def citation_id(file_id: Column, pos: Column) -> Column:
    return F.concat_ws(":", file_id.cast("string"), pos.cast("string"))


def _first_named(fields: Column) -> Column:
    """array<struct(name, text)>: the first field of each lower-cased name of an entry's fields."""

    def of(named: Column, names: Column) -> Column:
        return F.filter(named, lambda n, i: F.array_position(names, n["name"]) == i + 1)

    named = F.transform(fields, lambda f: F.struct(F.lower(f["name"]).alias("name"), f["text"].alias("text")))
    return bound(lambda named: bound(of, named, named["name"]), named)


def _inherited(fields: DataFrame, parents: DataFrame | None) -> DataFrame | None:
    """(file_id, pos, got array of name and text) of entries that get fields from others; None if no entry names one.

    Few entries name others, so that fields are shuffled only of those that do and, as parents, of their files.
    """
    named = F.lower("name").isin("crossref", "xdata") & (F.col("text") != "")
    naming = stored(fields.filter(named).select("file_id", "pos").distinct(), "naming")
    if naming.limit(1).count() == 0:
        return None
    given = (fields if parents is None else parents).join(naming.select("file_id").distinct(), "file_id", "left_semi")
    got = inherited_fields(fields.join(naming, ["file_id", "pos"], "left_semi"), given)
    return got.groupBy("file_id", "pos").agg(F.sort_array(F.collect_list(F.struct("name", "text"))).alias("got"))


def build_citations(entries: DataFrame, fields: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """entries (file_id, pos, type, key, text, fields), their fields as rows (file_id, pos, type, key, field_pos, name, text, ...) ->
    a row for each entry. `parents`: fields of the entries to inherit from, see `inherited_fields`.

    Columns: citation_id, file_id, pos, type, key, text, fields (as parsed), own (lower-cased names), f (name -> text, with what
    parents provide), inherited (names), raw_doi, authors_truncated, cites_preprint, work. Eager: which entries name others is written
    to the shared folder first. An entry's own fields are read where they are, in its array.
    """
    none = F.array().cast("array<string>")
    rows = entries.withColumns({"citation_id": citation_id(F.col("file_id"), F.col("pos")), "__own": F.coalesce(_first_named(F.col("fields")), F.array().cast(_NAMED))})
    got = _inherited(fields, parents)
    if got is None:
        rows = rows.withColumns({"f": F.map_from_entries("__own"), "inherited": none, "own": F.sort_array("__own.name")})
    else:
        rows = rows.join(got, ["file_id", "pos"], "left").withColumn("got", F.coalesce("got", F.array().cast(_NAMED)))
        rows = rows.withColumns({"f": F.map_from_entries(F.concat("__own", "got")), "inherited": F.sort_array("got.name"), "own": F.sort_array("__own.name")})
    of = lambda name: F.element_at("f", F.lit(name))
    some = lambda name: F.nullif(of(name), F.lit(""))
    rows = rows.withColumns({"raw_doi": of("doi"), "people": parse_authors(of("author")), "venue": F.coalesce(of("journal"), of("booktitle"), of("howpublished"), of("series"))})
    rows = rows.withColumn("doi", F.coalesce(parse_doi("raw_doi"), F.when(F.coalesce("raw_doi", F.lit("")) == "", find_doi(of("url")))))
    archive = F.lower(F.coalesce(of("archiveprefix"), of("eprinttype"), F.lit("")))
    eprint = F.when((archive == "arxiv") | parse_arxiv_id(some("eprint")).isNotNull(), parse_arxiv_id(some("eprint")))
    mention = F.coalesce(*(arxiv_mention(of(n)) for n in ("journal", "howpublished", "note", "url", "booktitle")))
    by_doi = F.when(F.col("doi").rlike(ARXIV_DOI), F.regexp_replace("doi", ARXIV_DOI, ""))
    rows = rows.withColumn("arxiv", F.coalesce(eprint, mention, by_doi))
    year = F.coalesce(of("year"), F.substring(of("date"), 1, 4))
    preprint = (F.col("arxiv").isNotNull() & (F.col("doi").isNull() | F.col("doi").rlike(r"^10\.48550/"))) | is_preprint_venue("venue") | (F.col("type") == "preprint")
    rows = rows.withColumns({"cites_preprint": F.coalesce(preprint, F.lit(False)), "year": F.when(F.trim(year).rlike(r"^\d{4}$"), F.trim(year).cast("int"))})
    values = {
        "title": decode_latex(some("title")), "authors": F.col("people.authors"), "year": F.col("year"), "venue": decode_latex(F.nullif("venue", F.lit(""))),
        "publisher": decode_latex(some("publisher")), "volume": of("volume"), "issue": F.coalesce(of("number"), of("issue")), "pages": of("pages"), "doi": F.col("doi"),
        "url": of("url"), "arxiv_id": F.col("arxiv"), "type": normalize_type("type"), "is_preprint": F.col("cites_preprint"), "related_dois": none, "sources": F.array(),
    }
    work = F.struct(*[values.get(n, F.lit(None)).alias(n) for n in WORK_FIELDS]).cast(WORK)
    return rows.withColumns({"work": work, "authors_truncated": F.coalesce("people.truncated", F.lit(False))}).select(
        "citation_id", "file_id", "pos", "type", "key", "text", "fields", "own", "f", "inherited", "raw_doi", "authors_truncated", "cites_preprint", "work"
    )
