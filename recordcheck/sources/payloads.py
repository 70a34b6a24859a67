"""Payloads of five metadata sources to works."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordcheck.functions.arrow import arrow_function
from recordcheck.functions.authors import split_display_name
from recordcheck.functions.identifiers import is_arxiv_doi, parse_arxiv_id, parse_doi, year_from
from recordcheck.functions.latex import strip_markup
from recordcheck.schema import AUTHORS, WORK

# Each source's types of works.
CROSSREF_TYPES = {
    "journal-article": "article", "proceedings-article": "inproceedings", "book-chapter": "incollection", "book-part": "incollection",
    "book-section": "incollection", "book": "book", "monograph": "book", "edited-book": "book", "reference-book": "book", "proceedings": "proceedings",
    "posted-content": "preprint", "dissertation": "phdthesis", "report": "techreport", "dataset": "dataset", "standard": "misc", "other": "misc",
}
DATACITE_TYPES = {
    "JournalArticle": "article", "ConferencePaper": "inproceedings", "Book": "book", "BookChapter": "incollection", "Dissertation": "phdthesis",
    "Report": "techreport", "Dataset": "dataset", "Software": "software", "Preprint": "preprint", "Text": "misc",
}
DBLP_TYPES = {
    "Conference and Workshop Papers": "inproceedings", "Journal Articles": "article", "Books and Theses": "book",
    "Parts in Books or Collections": "incollection", "Editorship": "proceedings", "Informal and Other Publications": "misc",
    "Informal Publications": "misc", "Reference Works": "misc", "Data and Artifacts": "dataset",
}
OPENALEX_TYPES = {
    "article": "article", "book-chapter": "incollection", "book": "book", "dissertation": "phdthesis", "preprint": "preprint", "report": "techreport",
    "dataset": "dataset", "standard": "misc", "other": "misc",
}
# Relations that name another version of a work.
CROSSREF_RELATIONS = ("is-preprint-of", "has-preprint", "is-version-of", "has-version")

_display_list = arrow_function(lambda names: None if names is None else [split_display_name(n)._asdict() for n in names], AUTHORS)


def _typed(table: dict[str, str], kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), kind), F.lit("misc"))


def _first(raw: Column) -> Column:
    """Of a value that may be a scalar or a list (read as a string): the scalar or the first item."""
    return F.coalesce(F.get_json_object(raw, "$[0]"), F.when(~raw.rlike(r"^\s*[\[{]"), raw))


def _list(raw: Column, item: str = "string") -> Column:
    """The same as a list: a scalar is a list of one, a missing value an empty one."""
    many = F.from_json(raw, f"array<{item}>")
    empty = F.array().cast(f"array<{item}>")
    single = F.array(F.from_json(raw, item)) if item.startswith("struct") else F.array(raw)
    return F.when(raw.isNull(), empty).when(F.ltrim(raw).startswith("["), F.coalesce(many, empty)).otherwise(single)


def _work(source: str, record_url: Column, native_id: Column, retrieved_at: Column | None, **values: Column) -> Column:
    """A WORK struct of the given values; all else is null."""
    at = F.lit(None) if retrieved_at is None else retrieved_at
    provenance = F.array(F.struct(F.lit(source).alias("source"), record_url.alias("record_url"), native_id.alias("native_id"), at.cast("timestamp").alias("retrieved_at")))
    defaults = {"authors": F.array(), "related_dois": F.array(), "is_preprint": F.lit(False)} | values | {"sources": provenance}
    names = re.findall(r"(?:^|,)(\w+):", re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", WORK[7:-1]))))
    return F.struct(*[defaults.get(n, F.lit(None)).alias(n) for n in names]).cast(WORK)


def _json(payload: str | Column, schema: str, parsed: bool) -> Column:
    value = F.col(payload) if isinstance(payload, str) else payload
    return value if parsed else F.from_json(value, schema)


_PARTS = "struct<`date-parts`:array<array<string>>>"
CROSSREF_SCHEMA = (
    f"DOI string, title string, subtitle string, author array<struct<family:string,given:string,name:string>>, issued {_PARTS}, `published-print` {_PARTS}, "
    f"`published-online` {_PARTS}, `container-title` string, `short-container-title` string, event struct<name:string>, publisher string, volume string, "
    "issue string, page string, type string, subtype string, ISBN string, ISSN string, URL string, resource struct<primary:struct<URL:string>>, "
    "relation map<string,array<struct<id:string,`id-type`:string>>>"
)


def map_crossref(payload: str | Column, retrieved_at: Column | None = None, parsed: bool = False) -> Column:
    """A work from a Crossref message."""
    m = _json(payload, CROSSREF_SCHEMA, parsed)
    title, subtitle, venue = (_first(m[c]) for c in ("title", "subtitle", "container-title"))
    full = F.when(F.coalesce(subtitle, F.lit("")) == "", title).when(F.contains(title, subtitle), title).otherwise(F.concat(title, F.lit(": "), subtitle))
    # A list of date parts that is there but empty still goes before the others.
    parts = F.coalesce(*(F.get(m[c]["date-parts"], F.lit(0)) for c in ("issued", "published-print", "published-online")))
    person = lambda a: F.when(F.coalesce(a["family"], F.lit("")) != "", F.struct(a["family"].alias("family"), F.coalesce(a["given"], F.lit("")).alias("given"), F.lit(None).cast("string").alias("literal"))).otherwise(
        F.struct(F.coalesce(a["name"], F.lit("")).alias("family"), F.lit("").alias("given"), F.coalesce(a["name"], F.lit("")).alias("literal"))
    )
    versions = F.flatten(F.array(*[F.coalesce(F.element_at(m["relation"], k), F.array().cast("array<struct<id:string,`id-type`:string>>")) for k in CROSSREF_RELATIONS]))
    dois = F.array_compact(F.transform(F.filter(versions, lambda r: r["id-type"] == "doi"), lambda r: parse_doi(r["id"], decoded=False)))
    doi = parse_doi(m["DOI"])
    return _work(
        "Crossref", F.concat(F.lit("https://api.crossref.org/works/"), F.url_encode(doi)), doi, retrieved_at,
        title=F.when(F.coalesce(title, F.lit("")) != "", strip_markup(full)), authors=F.coalesce(F.transform(m["author"], person), F.array()), year=year_from(F.get(parts, F.lit(0))),
        venue=F.when(F.coalesce(venue, F.lit("")) != "", strip_markup(venue)).otherwise(m["event"]["name"]), venue_short=_first(m["short-container-title"]), publisher=m["publisher"], volume=m["volume"], issue=m["issue"],
        pages=m["page"], doi=doi, url=F.coalesce(m["resource"]["primary"]["URL"], m["URL"]), isbn=F.when(m["ISBN"].isNotNull(), _list(m["ISBN"])), issn=F.when(m["ISSN"].isNotNull(), _list(m["ISSN"])),
        type=_typed(CROSSREF_TYPES, m["type"]), is_preprint=F.coalesce((m["type"] == "posted-content") | (m["subtype"] == "preprint"), m["type"] == "posted-content", F.lit(False)), related_dois=dois,
    )


DATACITE_SCHEMA = (
    "attributes struct<doi:string,titles:array<struct<title:string>>,creators:array<struct<name:string,nameType:string,familyName:string,givenName:string>>,"
    "publicationYear:string,container:struct<title:string,volume:string,issue:string,firstPage:string,lastPage:string>,publisher:string,url:string,"
    "types:struct<resourceTypeGeneral:string>,relatedIdentifiers:array<struct<relatedIdentifier:string,relatedIdentifierType:string,relationType:string>>>"
)


def map_datacite(payload: str | Column, retrieved_at: Column | None = None, parsed: bool = False) -> Column:
    """A work from a DataCite record."""
    a = _json(payload, DATACITE_SCHEMA, parsed)["attributes"]
    doi = parse_doi(a["doi"])
    arxiv = F.when(is_arxiv_doi(doi), F.regexp_replace(doi, r"(?i)^10\.48550/arxiv\.", ""))
    none = F.lit(None).cast("string")
    name = lambda c: F.coalesce(c["name"], F.lit(""))
    author = lambda family, given, literal=none: F.struct(family.alias("family"), given.alias("given"), literal.alias("literal"))
    creator = lambda c: (
        F.when(F.coalesce(c["familyName"], F.lit("")) != "", author(c["familyName"], F.coalesce(c["givenName"], F.lit(""))))
        .when(c["nameType"] == "Organizational", author(c["name"], F.lit(""), c["name"]))
        .otherwise(author(F.trim(F.split_part(name(c), F.lit(","), F.lit(1))), F.trim(F.split_part(name(c), F.lit(","), F.lit(2)))))
    )
    related = F.filter(a["relatedIdentifiers"], lambda r: (r["relatedIdentifierType"] == "DOI") & F.coalesce(r["relationType"], F.lit("")).rlike("(?i)version|preprint"))
    box = a["container"]
    both = (F.coalesce(box["firstPage"], F.lit("")) != "") & (F.coalesce(box["lastPage"], F.lit("")) != "")
    kind = a["types"]["resourceTypeGeneral"]
    publisher = F.when(F.ltrim(a["publisher"]).startswith("{"), F.get_json_object(a["publisher"], "$.name")).otherwise(a["publisher"])
    return _work(
        "DataCite", F.concat(F.lit("https://commons.datacite.org/doi.org/"), doi), doi, retrieved_at,
        title=F.get(a["titles"], F.lit(0))["title"], authors=F.coalesce(F.transform(a["creators"], creator), F.array()), year=year_from(a["publicationYear"]),
        venue=F.when(arxiv.isNotNull(), F.lit("arXiv")).otherwise(box["title"]), publisher=publisher, volume=box["volume"], issue=box["issue"],
        pages=F.when(both, F.concat(box["firstPage"], F.lit("--"), box["lastPage"])), doi=doi, url=a["url"], arxiv_id=arxiv,
        type=F.when(arxiv.isNotNull(), F.lit("preprint")).otherwise(_typed(DATACITE_TYPES, kind)), is_preprint=arxiv.isNotNull() | F.coalesce(kind == "Preprint", F.lit(False)),
        related_dois=F.coalesce(F.array_compact(F.transform(related, lambda r: parse_doi(r["relatedIdentifier"], decoded=False))), F.array()),
    )


DBLP_SCHEMA = "authors struct<author:string>, title string, venue string, volume string, number string, pages string, year string, type string, key string, doi string, ee string, url string"


def map_dblp(payload: str | Column, retrieved_at: Column | None = None, parsed: bool = False) -> Column:
    """A work from the info of a DBLP hit; any of its values may be a scalar or a list."""
    i = _json(payload, DBLP_SCHEMA, parsed)
    venue = _first(i["venue"])
    corr = F.coalesce(venue == "CoRR", F.lit(False))
    links = _list(i["ee"])
    paper = F.get(F.filter(links, lambda e: e.rlike(r"(?i)arxiv\.org/abs/")), F.lit(0))
    names = F.transform(_list(i["authors"]["author"]), lambda a: F.when(F.ltrim(a).startswith("{"), F.coalesce(F.get_json_object(a, "$.text"), F.lit(""))).otherwise(a))
    return _work(
        "DBLP", F.coalesce(i["url"], F.concat(F.lit("https://dblp.org/rec/"), i["key"])), i["key"], retrieved_at,
        title=F.regexp_replace(i["title"], r"\.$", ""), authors=_display_list(names), year=year_from(i["year"]), venue=venue, venue_short=venue, volume=F.when(~corr, i["volume"]), issue=i["number"],
        pages=i["pages"], doi=parse_doi(i["doi"]), url=F.get(links, F.lit(0)),
        arxiv_id=F.coalesce(F.regexp_extract(paper, "(?i)abs/(.*?)(?:abs/|$)", 1), F.when(corr, F.regexp_replace(i["volume"], "^abs/", ""))),
        type=F.when(corr, F.lit("preprint")).otherwise(_typed(DBLP_TYPES, i["type"])), is_preprint=corr,
    )


OPENALEX_SCHEMA = (
    "id string, doi string, display_name string, title string, publication_year string, type string, authorships array<struct<author:struct<display_name:string>,"
    "raw_author_name:string>>, primary_location struct<landing_page_url:string,source:struct<display_name:string,type:string,host_organization_name:string,issn:array<string>>>, "
    "locations array<struct<landing_page_url:string>>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>"
)


def map_openalex(payload: str | Column, retrieved_at: Column | None = None, parsed: bool = False) -> Column:
    """A work from an OpenAlex record."""
    w = _json(payload, OPENALEX_SCHEMA, parsed)
    place, biblio = w["primary_location"]["source"], w["biblio"]
    first, last = biblio["first_page"], biblio["last_page"]
    preprint_place = F.coalesce(F.regexp_like(place["display_name"], F.lit("(?i)arxiv")), F.lit(False))
    paper = F.get(F.filter(w["locations"], lambda x: F.coalesce(x["landing_page_url"], F.lit("")).rlike(r"(?i)arxiv\.org/abs/")), F.lit(0))["landing_page_url"]
    names = F.transform(w["authorships"], lambda a: F.coalesce(a["author"]["display_name"], a["raw_author_name"], F.lit("")))
    range_ = (F.coalesce(first, F.lit("")) != "") & (F.coalesce(last, F.lit("")) != "") & (first != last)
    return _work(
        "OpenAlex", w["id"], w["id"], retrieved_at,
        title=F.coalesce(w["display_name"], w["title"]), authors=F.coalesce(_display_list(names), F.array().cast(AUTHORS)), year=year_from(w["publication_year"]), venue=place["display_name"],
        publisher=place["host_organization_name"], volume=biblio["volume"], issue=biblio["issue"], pages=F.when(range_, F.concat(first, F.lit("--"), last)).otherwise(first),
        doi=parse_doi(w["doi"]), url=w["primary_location"]["landing_page_url"], arxiv_id=F.regexp_extract(paper, "(?i)abs/(.*?)(?:abs/|$)", 1), issn=place["issn"],
        type=F.when((w["type"] == "article") & (place["type"] == "conference"), F.lit("inproceedings")).otherwise(_typed(OPENALEX_TYPES, w["type"])),
        is_preprint=F.coalesce(w["type"] == "preprint", F.lit(False)) | preprint_place,
    )


def _entities(text: Column) -> Column:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.regexp_replace(text, r"\s+", " ")


def _tag(entry: Column, name: str) -> Column:
    """Text of the first element whose name begins so; null where there is none."""
    return F.when(entry.rlike(rf"(?s)<{name}[^>]*>.*?</{name}>"), _entities(F.regexp_replace(F.regexp_extract(entry, rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1), r"^\s+|\s+$", "")))


def map_arxiv(payload: str | Column, retrieved_at: Column | None = None) -> Column:
    """A work from the first entry of an arXiv Atom feed; null without an identifier or a title."""
    xml = F.col(payload) if isinstance(payload, str) else payload
    entry = F.regexp_extract(xml, r"(?s)(<entry>.*?)(?:</entry>|$)", 1)
    bare = F.regexp_replace(parse_arxiv_id(_tag(entry, "id")), r"v\d+$", "")
    title = _tag(entry, "title")
    names = F.transform(F.regexp_extract_all(entry, F.lit(r"<author>\s*<name>([^<]{1,300})</name>"), 1), _entities)
    published = parse_doi(_tag(entry, "arxiv:doi"))
    page = F.concat(F.lit("https://arxiv.org/abs/"), bare)
    work = _work(
        "arXiv", page, bare, retrieved_at,
        title=title, authors=_display_list(names), year=year_from(_tag(entry, "published")), venue=F.lit("arXiv"), doi=F.concat(F.lit("10.48550/arXiv."), bare), url=page, arxiv_id=bare,
        type=F.lit("preprint"), is_preprint=F.lit(True), related_dois=F.array_compact(F.array(published)),
    )
    return F.when(bare.isNotNull() & (F.coalesce(title, F.lit("")) != "") & (F.lower(title) != "error"), work)


MAPPERS = {"Crossref": map_crossref, "DataCite": map_datacite, "DBLP": map_dblp, "OpenAlex": map_openalex, "arXiv": map_arxiv}
SCHEMAS = {"Crossref": CROSSREF_SCHEMA, "DataCite": DATACITE_SCHEMA, "DBLP": DBLP_SCHEMA, "OpenAlex": OPENALEX_SCHEMA}


def with_work(rows: DataFrame, source: str, payload: Column, retrieved_at: Column | None = None, work: str = "work") -> DataFrame:
    """Rows with the work of a source's payload. JSON is parsed in a projection of its own, once for all values that are read
    from it: a mapper over the text itself is planned with a parse for each of them."""
    if source not in SCHEMAS:
        return rows.withColumn(work, MAPPERS[source](payload, retrieved_at))
    parsed = rows.withColumn("__parsed", F.from_json(payload, SCHEMAS[source]))
    return parsed.withColumn(work, MAPPERS[source]("__parsed", retrieved_at, True)).drop("__parsed")
