"""BibTeX text to tables that keep exact source spans.

A text gives one row for each item: entries, string definitions, preambles, comments, free text and errors. Offsets count code
points from the begin of the text. The scanner goes forward once and steps over what it cannot read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from recordcheck.functions.latex import decode_latex
from recordcheck.schema import ITEM_COLUMNS
from recordcheck.storage import dealt


@dataclass(frozen=True)
class Limits:
    """Bounds on what is read. Fields and entries are counted after they are added."""

    file_chars: int = 5_000_000
    entry_chars: int = 100_000
    field_chars: int = 20_000
    depth: int = 64
    fields: int = 200
    entries: int = 20_000


# Items that are handed on together.
BATCH = 2048

# Fixed value: entries that a list shows at once.
SHOWN = 500

# Months that need no definition.
MONTHS = {
    "jan": "January", "feb": "February", "mar": "March", "apr": "April", "may": "May", "jun": "June", "jul": "July", "aug": "August",
    "sep": "September", "oct": "October", "nov": "November", "dec": "December",
}
# Entry types that styles know.
ENTRY_TYPES = (
    "article", "inproceedings", "conference", "proceedings", "book", "inbook", "incollection", "phdthesis", "mastersthesis", "techreport", "misc",
    "online", "software", "dataset", "unpublished", "manual", "booklet", "thesis", "report", "collection", "electronic", "www", "patent",
    "periodical", "suppbook", "suppcollection", "reference", "mvbook", "mvcollection", "mvproceedings", "bookinbook", "inreference", "set", "xdata",
    "preprint",
)
MACRO_DEPTH = 8

_BLANK = re.compile(r"[ \t\n\r\f\v]*")
_NAME = re.compile(r'[^ \t\n\r\f\v{}(),="#@%]+')
_DIGITS = re.compile("[0-9]+")
_BRACE = re.compile("[{}]")
_QUOTE = re.compile('[{}"]')
_RESUME = re.compile(r"(?<=\s)@")
_KEYS = {close: re.compile(rf"[^,{re.escape(close)} \t\n\r\f\v]*") for close in "})"}
#: A field of one part without braces in it, and the sign after it: most fields are such. All others are read step by step.
# Braces in braces are read one deep; behind a comma the brace that closes the entry, if it comes next.
_PLAIN_FIELD = re.compile(
    r"""[ \t\n\r\f\v]*([^ \t\n\r\f\v{}(),="#@%]+)[ \t\n\r\f\v]*=[ \t\n\r\f\v]*(\{([^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+)\}|"([^{}"]*)"|([0-9]+))[ \t\n\r\f\v]*(?:(,)(?:[ \t\n\r\f\v]*(\}))?|([)}]))"""
)
_PLAIN_HEAD = re.compile(r"""@[ \t\n\r\f\v]*([^ \t\n\r\f\v{}(),="#@%]+)[ \t\n\r\f\v]*\{[ \t\n\r\f\v]*([^,} \t\n\r\f\v]*)[ \t\n\r\f\v]*,""")
_PLAIN_KINDS = (None, None, None, "braced", "quoted", "number")


class BibSyntaxError(ValueError):
    def __init__(self, message: str, position: int):
        super().__init__(message)
        self.position = position


class _Reader:
    """A place in a text, and the steps that move it forward."""

    def __init__(self, text: str, limits: Limits):
        self.text, self.limits, self.at = text, limits, 0

    def blank(self) -> str:
        """The next character after white space, '' at the end."""
        self.at = _BLANK.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def take(self, sign: str) -> None:
        found = self.blank()
        if found != sign:
            raise BibSyntaxError(f'Expected "{sign}" but found "{found or "end of input"}"', self.at)
        self.at += 1

    def name(self, what: str) -> tuple[str, int, int]:
        self.blank()
        m = _NAME.match(self.text, self.at)
        if not m:
            raise BibSyntaxError(f"Expected {what}", self.at)
        self.at = m.end()
        return m[0], m.start(), m.end()

    def group(self, quoted: bool) -> str:
        """The inside of braces or quotes; quotes end only outside braces."""
        begin, depth = self.at, 0 if quoted else 1
        for m in (_QUOTE if quoted else _BRACE).finditer(self.text, begin + 1):
            if m[0] == "{":
                depth += 1
                if depth > self.limits.depth:
                    raise BibSyntaxError("Braces nested too deeply", m.start())
            elif m[0] == "}":
                depth -= 1
                if depth < 0:
                    raise BibSyntaxError('Unbalanced "}" inside quoted value', m.start())
            if depth == 0 and m[0] == ('"' if quoted else "}"):
                self.at = m.end()
                if m.start() - begin - 1 > self.limits.field_chars:
                    raise BibSyntaxError("Field value too long", begin + 1)
                return self.text[begin + 1 : m.start()]
        raise BibSyntaxError("Unterminated quoted value" if quoted else 'Unbalanced braces: missing "}"', begin)

    def value(self) -> tuple[list[dict], int, int]:
        """Parts joined by #, and the span without white space around it."""
        parts, begin = [], None
        while True:
            sign = self.blank()
            begin = self.at if begin is None else begin
            if sign == "{":
                part = {"kind": "braced", "text": self.group(False)}
            elif sign == '"':
                part = {"kind": "quoted", "text": self.group(True)}
            elif digits := _DIGITS.match(self.text, self.at):
                self.at = digits.end()
                part = {"kind": "number", "text": digits[0]}
            elif _NAME.match(self.text, self.at):
                part = {"kind": "macro", "text": self.name("macro name")[0]}
            else:
                raise BibSyntaxError("Expected a field value", self.at)
            parts.append(part)
            end = self.at
            if self.blank() != "#":
                return parts, begin, end
            self.at += 1


def _entry(r: _Reader, at: int, kind: tuple[str, int, int], opened: str, close: str) -> dict:
    r.blank()
    key = _KEYS[close].match(r.text, r.at)
    r.at = key.end()
    after = r.blank()
    if after and after not in ("," + close):
        raise BibSyntaxError(f'Citation key "{key[0]}" is followed by "{after}". BibTeX keys cannot contain spaces or braces.', key.end())
    r.at += after == ","
    fields = []
    while True:
        plain = _PLAIN_FIELD.match(r.text, r.at)
        if plain and (plain[6] or plain[8] == close) and plain.end(2) - plain.start(2) <= r.limits.field_chars and (r.limits.depth > 1 or "{" not in plain[2][1:]):
            kind_of = 3 if plain[3] is not None else 4 if plain[4] is not None else 5
            part = {"kind": _PLAIN_KINDS[kind_of], "text": plain[kind_of]}
            fields.append({"name": plain[1], "name_start": plain.start(1), "name_end": plain.end(1), "value_start": plain.start(2), "value_end": plain.end(2), "raw": plain[2], "parts": [part]})
            if len(fields) > r.limits.fields:
                raise BibSyntaxError("Too many fields in one entry", plain.start(1))
            r.at = plain.end(6) if plain[6] else plain.start(8)
            continue
        if (sign := r.blank()) == close:
            break
        unclosed = BibSyntaxError(f'Entry "{key[0]}" is missing its closing "{close}"', at)
        if not sign:
            raise unclosed
        name, start, end = r.name("field name")
        r.take("=")
        parts, first, last = r.value()
        fields.append({"name": name, "name_start": start, "name_end": end, "value_start": first, "value_end": last, "raw": r.text[first:last], "parts": parts})
        if len(fields) > r.limits.fields:
            raise BibSyntaxError("Too many fields in one entry", start)
        sign = r.blank()
        if sign == ",":
            r.at += 1
        elif not sign:
            raise unclosed
        elif sign != close:
            raise BibSyntaxError(f'Expected "," or "{close}" after field "{name}"', r.at)
    shut, r.at = r.at, r.at + 1
    if r.at - at > r.limits.entry_chars:
        raise BibSyntaxError("Entry is too large to analyze", at)
    return {
        "kind": "entry", "type": kind[0].lower(), "type_start": kind[1], "type_end": kind[2], "key": key[0], "key_start": key.start(), "key_end": key.end(),
        "fields": fields, "close_pos": shut, "open_delim": opened, "text": r.text[at : r.at],
    }


def item_at(text: str, at: int, limits: Limits) -> tuple[dict | None, int, bool]:
    """What the @ at a position begins -> (item, its end, whether a type was read).

    The item is None for an @ in running text, and of kind error, with message and start, where it cannot be read.
    """
    r, named = _Reader(text, limits), False
    r.at = at + 1
    try:
        kind = r.name('entry type after "@"')
        opened = r.blank()
        if opened not in ("{", "("):
            return None, at + 1, False
        named, close, word = True, "}" if opened == "{" else ")", kind[0].lower()
        if word == "comment":
            if opened == "{":
                r.group(False)
            else:
                r.at = text.find(")", r.at) + 1 or len(text)
            item = {"kind": "comment", "text": text[at : r.at]}
        elif word in ("preamble", "string"):
            r.at += 1
            item = {"kind": word}
            if word == "string":
                item["name"] = r.name("string name")[0]
                r.take("=")
            item["parts"] = r.value()[0]
            r.take(close)
        else:
            r.at += 1
            item = _entry(r, at, kind, opened, close)
        return item | {"start": at, "end": r.at}, r.at, True
    except BibSyntaxError as e:
        return {"kind": "error", "message": str(e), "start": e.position}, at + 1, named


def resumed(text: str, at: int) -> int:
    """Where reading goes on after an error at the @ of that position: the next @ that follows white space, -1 if none does."""
    m = _RESUME.search(text, at + 1)
    return m.start() if m else -1


def parse_bibtex(text: str, limits: Limits = Limits()) -> list[dict]:
    """Items in text order; errors come where they were met, with their position as start and a 1-based line."""
    items: list[dict] = []
    error = lambda message, at: items.append({"kind": "error", "message": message, "start": at, "line": text.count("\n", 0, at) + 1})
    if len(text) > limits.file_chars:
        items.append({"kind": "error", "message": f"Input is larger than {limits.file_chars:,} characters", "start": 0, "line": 1})
        return items
    free, at, entries = 0, text.find("@"), 0

    def loose(end: int) -> None:
        if text[free:end].strip():
            items.append({"kind": "comment", "text": text[free:end], "start": free, "end": end})

    while at >= 0:
        item, resume, named = item_at(text, at, limits)
        if item is None:
            at = text.find("@", at + 1)
            continue
        if named:
            loose(at)
        if item["kind"] == "error":
            error(item["message"], item["start"])
            at = resumed(text, at)
            free = len(text) if at < 0 else at
            continue
        entries += item["kind"] == "entry"
        items.append(item)
        free = resume
        if entries > limits.entries:
            error("Too many entries; stopped parsing", resume)
            return items
        at = text.find("@", resume)
    loose(len(text))
    return items


def value_text(parts: list[dict], strings: dict[str, list[dict]], depth: int = 0) -> tuple[str, list[str]]:
    """Text of a value with macros expanded, and the names of those that have no definition."""
    text, missing = [], []
    for part in parts:
        name = part["text"].lower()
        if part["kind"] != "macro":
            text.append(part["text"])
        elif name in strings and depth < MACRO_DEPTH:
            inner, lost = value_text(strings[name], strings, depth + 1)
            text.append(inner)
            missing += lost
        elif name in MONTHS:
            text.append(MONTHS[name])
        else:
            text.append(part["text"])
            missing.append(part["text"])
    return "".join(text), missing


def parsed_rows(text: str | None, limits: Limits = Limits()) -> list[dict]:
    """parse_bibtex with positions in the list, and field texts under the text's own definitions."""
    items = parse_bibtex(text or "", limits)
    strings = {i["name"].lower(): i["parts"] for i in items if i["kind"] == "string"}
    for pos, item in enumerate(items):
        item["pos"] = pos
        for field in item.get("fields") or ():
            field["text"], field["unresolved"] = value_text(field["parts"], strings)
    return items


def first_parts(text: str | None, limits: Limits = Limits()) -> dict[str, str]:
    """The first entry's values by lower-cased name, the first of each, with its KEY and ENTRYTYPE; {} if there is none.

    An entry of plain fields at the text's first @ is read without its spans.
    """
    text = text or ""
    head = _PLAIN_HEAD.match(text, max(text.find("@"), 0))
    if head and len(text) <= limits.file_chars and head[1].lower() not in ("comment", "preamble", "string"):
        parts: dict[str, str] = {}
        at, count = head.end(), 0
        while m := _PLAIN_FIELD.match(text, at):
            name, raw, braced, quoted, number, _, shut, sign = m.groups()
            if sign == ")" or count >= limits.fields or len(raw) > limits.field_chars or (limits.depth < 2 and "{" in raw[1:]):
                break
            parts.setdefault(name.lower(), braced if braced is not None else quoted if quoted is not None else number)
            at, count = m.end(), count + 1
            if shut or sign:
                if at - head.start() > limits.entry_chars:
                    break
                parts["KEY"], parts["ENTRYTYPE"] = head[2], head[1].lower()
                return parts
    entry = next((i for i in parsed_rows(text, limits) if i["kind"] == "entry"), None)
    if entry is None:
        return {}
    first: dict[str, str] = {}
    for f in entry["fields"]:
        first.setdefault(f["name"].lower(), f["text"])
    return first | {"KEY": entry["key"], "ENTRYTYPE": entry["type"]}


def items(files: DataFrame, id_col: str = "file_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(file_id, text) -> a row for each item of each text. A null text has none.

    Texts are dealt over tasks by their id, as a table of a few MB, which one task would read, may hold a million of them.
    """
    kind = files.schema[id_col].dataType.simpleString()
    ddl = f"file_id {kind}, {ITEM_COLUMNS}"
    schema = _parse_datatype_string(ddl)
    assert isinstance(schema, StructType)
    arrow = to_arrow_schema(schema)
    blank = dict.fromkeys(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for file_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [blank | item | {"file_id": file_id} for item in parsed_rows(text, limits)]
                if len(rows) >= BATCH:
                    for k in range(0, len(rows), BATCH):
                        yield pa.RecordBatch.from_pylist(rows[k : k + BATCH], schema=arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    texts = files.select(files[id_col].alias("file_id"), files[text_col].cast("string").alias("text"))
    return dealt(texts, "file_id").mapInArrow(run, ddl)


def register(spark: SparkSession) -> None:
    """SQL: SELECT ... FROM t, LATERAL parse_bibtex(t.text)."""

    class ParseBibtex:
        def eval(self, text: str):
            for i in parsed_rows(text):
                for k, f in enumerate(i.get("fields") or [None]):
                    yield (i["pos"], i["kind"], i.get("type"), i.get("key"), k if f else None, f and f["name"], f and f["text"], i.get("message"))

    spark.udtf.register("parse_bibtex", F.udtf(ParseBibtex, returnType="pos int, kind string, type string, key string, field_pos int, field string, value string, message string"))


def entries(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'entry'").select("file_id", "pos", "type", "key", "text", "start", "end", "fields")


def fields(parsed: DataFrame) -> DataFrame:
    """A row for each field of each entry, in order."""
    rows = parsed.filter("kind = 'entry'").select("file_id", "pos", "type", "key", F.posexplode("fields").alias("field_pos", "f"))
    return rows.select("file_id", "pos", "type", "key", "field_pos", "f.*")


def strings(parsed: DataFrame) -> DataFrame:
    """The definition of each macro of a file; of several the last."""
    rows = parsed.filter("kind = 'string'").select("file_id", F.lower("name").alias("name"), "pos", "parts")
    return rows.groupBy("file_id", "name").agg(F.max_by("parts", "pos").alias("parts"))


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'error'").select("file_id", F.col("start").alias("position"), "line", "message")


def first_fields(rows: DataFrame) -> DataFrame:
    """The first field of each lower-cased name of an entry."""
    return rows.withColumn("name", F.lower("name")).groupBy("file_id", "pos", "name").agg(F.min_by("text", "field_pos").alias("text"))


def references(own: DataFrame) -> DataFrame:
    """(file_id, pos, via, nth, ref): the keys that entries' crossref and xdata fields name, in lower case and in order."""
    order = F.when(F.col("name") == "crossref", 0).otherwise(1)
    named = own.filter("name IN ('crossref', 'xdata') AND text <> ''").select("file_id", "pos", order.alias("via"), F.posexplode(F.split("text", ",")).alias("nth", "ref"))
    return named.select("file_id", "pos", "via", "nth", F.lower(F.trim("ref")).alias("ref")).filter("ref <> ''")


def inherited_fields(rows: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(file_id, pos, name, text) that entries get from those their crossref and xdata fields name.

    Keys are compared without case, the first entry of a key counts, a parent's title becomes a booktitle where the types
    differ, and fields an entry has itself, or got from an earlier parent, are left alone. `parents` are fields of the entries
    that may be named, by default `rows` themselves.
    """
    given = rows if parents is None else parents
    own = first_fields(rows)
    heads = given.select("file_id", "pos", "type", F.lower("key").alias("ref")).distinct()
    first = heads.groupBy("file_id", "ref").agg(F.min_by(F.struct("pos", "type"), "pos").alias("parent"))
    types = rows.select("file_id", "pos", F.col("type").alias("own_type")).distinct()
    found = references(own).join(first, ["file_id", "ref"]).join(types, ["file_id", "pos"])
    theirs = given.select("file_id", F.col("pos").alias("parent_pos"), "field_pos", F.lower("name").alias("name"), "text")
    got = found.select("file_id", "pos", "via", "nth", "own_type", "parent.type", F.col("parent.pos").alias("parent_pos")).join(theirs, ["file_id", "parent_pos"])
    name = F.when((F.col("name") == "title") & (F.col("own_type") != F.col("type")), F.lit("booktitle")).otherwise(F.col("name"))
    got = got.withColumn("name", name).join(own.select("file_id", "pos", "name"), ["file_id", "pos", "name"], "left_anti")
    return got.groupBy("file_id", "pos", "name").agg(F.min_by("text", F.struct("via", "nth", "field_pos")).alias("text"))


def list_entries(parsed: DataFrame) -> DataFrame:
    """Choices: (file_id, index, key, type, title, year, text)."""
    rows = entries(parsed).withColumn("index", F.row_number().over(Window.partitionBy("file_id").orderBy("pos")) - 1)
    value = lambda name: F.get(F.filter("fields", lambda f: F.lower(f["name"]) == name), F.lit(0))["text"]
    return rows.select("file_id", "index", "key", "type", decode_latex(F.nullif(value("title"), F.lit(""))).alias("title"), value("year").alias("year"), "text")


def filter_choices(choices: DataFrame, query: str) -> DataFrame:
    """Choices whose key, title or year contains the query; case does not matter, a blank query keeps all."""
    needle = query.strip().lower()
    if not needle:
        return choices
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle))
    return choices.filter(has("key") | has("title") | F.contains(F.coalesce("year", F.lit("")), F.lit(needle)))


def shown_choices(choices: DataFrame, query: str = "", limit: int = SHOWN) -> DataFrame:
    """The first `limit` choices of each file that contain the query, in the order of the file."""
    order = Window.partitionBy("file_id").orderBy("index")
    return filter_choices(choices, query).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= limit).drop("__n")


def list_summary(parsed: DataFrame) -> DataFrame:
    """(file_id, keys, entries, errors): a file's distinct citation keys, and how many entries and unreadable parts it has."""
    entry = F.col("kind") == "entry"
    keys = F.sort_array(F.collect_set(F.when(entry, F.col("key"))))
    return parsed.groupBy("file_id").agg(keys.alias("keys"), F.count_if(entry).alias("entries"), F.count_if(F.col("kind") == "error").alias("errors"))


def read_files(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(file_id, text) of .bib, .bibtex and .txt files of at most as many bytes as a file may have characters."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    chosen = found.filter(F.lower("path").rlike(r"\.(?:bib|bibtex|txt)$") & (F.col("length") <= limits.file_chars))
    return chosen.select(F.col("path").alias("file_id"), F.decode("content", "UTF-8").alias("text"))


def safe_filename(key: str | Column) -> Column:
    base = F.substring(F.regexp_replace(F.coalesce(key if isinstance(key, Column) else F.col(key), F.lit("entry")), "[^A-Za-z0-9._-]+", "_"), 1, 80)
    return F.concat(F.when(base == "", F.lit("entry")).otherwise(base), F.lit(".bib"))
