"""A Spark data source for BibTeX files: `spark.read.format("bibtex")` and `df.write.format("bibtex")`.

Files up to `Limits.file_chars` bytes are read whole, as `parse_bibtex` reads them, some of them in one task. A larger file is cut
into ranges of bytes, and each range is read by a task of its own, which returns the items whose @ lies in it. What an @ begins
does not depend on what is before it, only whether the @ is reached does; so a task walks from every @ of a stretch of text before
its range, and knows where reading enters the range once all those walks have met. If they have not, it looks further back, at last
to the begin of the file. Rows are therefore the same for any size of the ranges.

In larger files an item is read within the `entry_chars` characters from its @, and free text comes in pieces that end at the next
@. There is no bound on the file or the number of its entries.

Positions count from the begin of the range. A row of kind `range` ends each range, with the characters, line feeds and items that it
has; `read_bibtex` adds them up and turns positions into those of the file.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from recordcheck.schema import ITEM_COLUMNS
from recordcheck.sources.bibtex import Limits, item_at, parse_bibtex, resumed, safe_filename
from recordcheck.storage import stored

#: Bytes of a range of a large file, and of the small files that one task reads.
RANGE_BYTES = 8 << 20
COLUMNS = f"file_id string, range int, chars bigint, lines bigint, {ITEM_COLUMNS}"
NAMES = re.compile(r"\.(?:bib|bibtex|txt)$", re.IGNORECASE)
#: Bytes that a code point may have, and bytes that are read ahead at a time.
WIDEST, AHEAD = 4, 1 << 18
ROWS = 2048


@dataclass(frozen=True)
class Range:
    file_id: str
    number: int
    begin: int
    end: int
    size: int


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    ranges: list[Range]

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def listed(path: str) -> Iterator[tuple[str, int]]:
    """(URI, bytes) of the BibTeX files at or below a path, in order."""
    store, root = fs.FileSystem.from_uri(path)
    head = path[: len(path) - len(root)] if path.endswith(root) else ""
    found = store.get_file_info(root)
    infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    for info in sorted(infos, key=lambda i: i.path):
        hidden = any(part[:1] in "._" for part in info.path[len(root) :].split("/") if part)
        if info.type == fs.FileType.File and NAMES.search(info.path) and not hidden:
            yield head + info.path, info.size


def planned(files: Iterator[tuple[str, int]], range_bytes: int, whole_bytes: int) -> list[Ranges]:
    """Ranges of large files one by one, small files together up to the bytes of a range."""
    out, few, held = [], [], 0
    for name, size in files:
        if size > whole_bytes:
            cuts = [*range(0, size, range_bytes), size]
            out += [Ranges([Range(name, k, a, b, size)]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            continue
        if few and held + size > range_bytes:
            out.append(Ranges(few))
            few, held = [], 0
        few.append(Range(name, 0, 0, size, size))
        held += size
    return out + ([Ranges(few)] if few else [])


class _Window:
    """Text of a file around a range: from some place before it to as far behind it as was asked for."""

    def __init__(self, stream, r: Range):
        self.stream, self.r = stream, r
        begin, end = self._aligned(r.begin), self._aligned(r.end)
        self.own = self._read(begin, end).decode("utf-8", "replace")
        self.first, self.at, self.rest = begin, end, b""
        self.text, self.begin = self.own, 0

    def _read(self, a: int, b: int) -> bytes:
        self.stream.seek(a)
        return self.stream.read(b - a)

    def _aligned(self, at: int) -> int:
        """The first place at or behind `at` that is no inner byte of a code point."""
        tail = self._read(at, min(at + WIDEST, self.r.size))
        return at + next((k for k, byte in enumerate(tail) if byte & 0xC0 != 0x80), len(tail)) if at else 0

    def back(self, chars: int) -> bool:
        """Put at least so many characters, or all there are, before the range; whether the text now begins with the file."""
        at = self._aligned(max(0, self.first - WIDEST * chars))
        before = self._read(at, self.first).decode("utf-8", "replace")
        self.text, self.begin = before + self.text[self.begin :], len(before)
        return at == 0

    def more(self) -> bool:
        """Take in more text behind; False at the end of the file."""
        if self.at >= self.r.size:
            return False
        block = self.rest + self._read(self.at, min(self.at + AHEAD, self.r.size))
        self.at = min(self.at + AHEAD, self.r.size)
        whole = len(block)
        if self.at < self.r.size:  # a code point that goes on behind the block waits for the next one
            start = next((k for k in range(1, min(WIDEST, whole) + 1) if block[-k] & 0xC0 != 0x80), 1)
            if block[-start] >= 0xC0:
                whole -= start
        self.rest, block = block[whole:], block[:whole]
        self.text += block.decode("utf-8", "replace")
        return True

    def ensure(self, end: int) -> None:
        while len(self.text) < end and self.more():
            pass

    def find(self, search, at: int) -> int:
        """Where search(text, at) finds something, reading on as long as it does not; -1 at the end of the file."""
        while (found := search(self.text, at)) < 0:
            at = max(at, len(self.text) - 1)
            if not self.more():
                return -1
        return found


def _sign(text: str, at: int) -> int:
    return text.find("@", at)


def _step(w: _Window, at: int, limits: Limits) -> tuple[dict | None, int, int]:
    """What an @ begins, with positions from the @; where free text goes on; and the next @ that is reached."""
    w.ensure(at + limits.entry_chars)
    item, end, _ = item_at(w.text[at : at + limits.entry_chars], 0, limits)
    if item is not None and item["kind"] == "error":
        found = w.find(resumed, at)
        return item, found if found >= 0 else len(w.text), found
    return item, at + (end if item else 0), w.find(_sign, at + end)


def entered(w: _Window, limits: Limits) -> int:
    """The first @ of a range that reading reaches, -1 if there is none in the rest of the file."""
    reach, chars = limits.entry_chars, 3 * limits.entry_chars
    while True:
        whole = w.back(chars)
        if whole:
            starts = [at] if 0 <= (at := w.find(_sign, 0)) else []
        else:  # an item that begins before the stretch ends in it, and an error goes on at the sign behind white space
            last = next((k for k in range(w.begin - reach, reach, -1) if w.text[k] == "@" and w.text[k - 1].isspace()), None)
            starts = [] if last is None else [k for k in range(last - reach, last + 1) if w.text[k] == "@"]
        exits, met = {}, set()
        for start in reversed(starts):
            path, at = [], start
            while 0 <= at < w.begin and at not in exits:
                path.append(at)
                at = _step(w, at, limits)[2]
            at = exits.get(at, at)
            exits.update(dict.fromkeys(path, at))
            met.add(at)
            if len(met) > 1:
                break
        if len(met) == 1:
            return met.pop()
        if whole:
            return -1
        chars *= 2


def _pieces(w: _Window, begin: int, end: int, size: int) -> Iterator[dict]:
    for k in range(begin, end, size):
        text = w.text[k : min(k + size, end)]
        if text.strip():
            yield {"kind": "comment", "text": text, "start": k, "end": k + len(text)}


SPANS = ("start", "end", "type_start", "type_end", "key_start", "key_end", "close_pos")


def shifted(item: dict, by: int) -> dict:
    """An item with all its positions moved."""
    out = item | {k: item[k] + by for k in SPANS if item.get(k) is not None}
    if item.get("fields"):
        spans = ("name_start", "name_end", "value_start", "value_end")
        out["fields"] = [f | {k: f[k] + by for k in spans} for f in item["fields"]]
    return out


def range_items(stream, r: Range, limits: Limits) -> Iterator[dict]:
    """Items of a range of a large file, then its row of kind `range`."""
    w = _Window(stream, r)
    at, count = (0, 0) if not r.number else (entered(w, limits), 0)
    if not r.number:
        at = w.find(_sign, 0)
    base, own_end = w.begin, w.begin + len(w.own)
    found = list(_pieces(w, base, at if at >= 0 else len(w.text), limits.entry_chars)) if not r.number else []
    line, counted = 1, base
    while 0 <= at < own_end:
        item, end, following = _step(w, at, limits)
        if item is not None:
            item = shifted(item, at)
            if item["kind"] == "error":
                spot = item["start"]
                line, counted = line + (w.text.count("\n", counted, spot) if spot >= counted else -w.text.count("\n", spot, counted)), spot
                item["line"] = line
            found.append(item)
        found += _pieces(w, end, following if following >= 0 else len(w.text), limits.entry_chars)
        for x in found:
            yield shifted(x, -base) | {"pos": count}
            count += 1
        found, at = [], following
    for x in found:
        yield shifted(x, -base) | {"pos": count}
        count += 1
    yield {"kind": "range", "pos": count, "chars": len(w.own), "lines": w.own.count("\n")}


class BibtexReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict, limits: Limits):
        self.schema, self.path, self.limits = schema, options["path"], limits
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.whole_bytes = int(options.get("wholebytes", limits.file_chars))

    def partitions(self) -> list[Ranges]:
        return planned(listed(self.path), self.range_bytes, self.whole_bytes)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        arrow, rows, blank = to_arrow_schema(self.schema), [], dict.fromkeys(self.schema.names)
        for r in partition.ranges if partition else ():
            store, name = fs.FileSystem.from_uri(r.file_id)
            with store.open_input_file(name) as stream:
                for item in self._items(stream, r):
                    rows.append(blank | item | {"file_id": r.file_id, "range": r.number})
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def _items(self, stream, r: Range) -> Iterator[dict]:
        if r.size > self.whole_bytes:
            yield from range_items(stream, r, self.limits)
            return
        text = stream.read().decode("utf-8", "replace")
        pos = -1
        for pos, item in enumerate(parse_bibtex(text, self.limits)):
            yield item | {"pos": pos}
        yield {"kind": "range", "pos": pos + 1, "chars": len(text), "lines": text.count("\n")}


@dataclass
class Written(WriterCommitMessage):
    """(temporary, final) names of the files that a task has written, and their entries."""

    files: list[tuple[str, str]]
    entries: int

    def __init__(self, files: list[tuple[str, str]], entries: int):
        self.files, self.entries = files, entries


class BibtexWriter(DataSourceArrowWriter):
    """Texts of entries to files, one for each run of equal names in `file`, or one a task if there is no such column.

    Tasks write below a folder of their own; commit moves what the successful ones wrote to its place and then writes `_SUCCESS`.
    Abort deletes that folder and leaves earlier files alone. Two tasks or runs with one file name are an error.
    """

    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path.rstrip("/"), names, overwrite
        self.job = uuid.uuid4().hex
        if "text" not in names:
            raise ValueError("a BibTeX file is written from a column `text`")

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.path)
        return store, root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._store()
        attempt = f"{root}/_temporary-{self.job}/{uuid.uuid4().hex}"
        store.create_dir(attempt, recursive=True)
        files, now, out, entries = [], None, None, 0
        try:
            for b in iterator:
                texts = b.column(self.names.index("text")).to_pylist()
                named = b.column(self.names.index("file")).to_pylist() if "file" in self.names else [f"part-{attempt.rpartition('/')[2]}.bib"] * len(texts)
                for name, text in zip(named, texts):
                    if text is None:
                        continue
                    if name != now or out is None:
                        if out:
                            out.close()
                        if "/" in (name or "/"):
                            raise ValueError(f"no file name: {name!r}")
                        if any(final == name for _, final in files):
                            raise ValueError(f"rows of {name} are not together; sort them by file")
                        now, out = name, store.open_output_stream(f"{attempt}/{len(files)}")
                        files.append((f"{attempt}/{len(files)}", name))
                    out.write((text if text.endswith("\n") else text + "\n").encode("utf-8", "replace"))
                    entries += 1
        finally:
            if out:
                out.close()
        return Written(files, entries)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        finals = [final for _, final in files]
        if len(set(finals)) < len(finals):
            self._clean(store, root)
            raise ValueError("two tasks wrote one file; repartition by file")
        kept = set(finals)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.type == fs.FileType.File and NAMES.search(info.path) and info.base_name not in kept:
                    store.delete_file(info.path)
        for temporary, final in files:
            store.move(temporary, f"{root}/{final}")
        self._clean(store, root)
        with store.open_output_stream(f"{root}/_SUCCESS") as done:
            done.write(str(sum(m.entries for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*self._store())

    def _clean(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/_temporary-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary-{self.job}")


class BibtexSource(DataSource):
    """Options of reading: rangeBytes, wholeBytes (larger files are cut into ranges), entryChars."""

    @classmethod
    def name(cls) -> str:
        return "bibtex"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> BibtexReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return BibtexReader(schema, options, Limits(entry_chars=int(options.get("entrychars", Limits.entry_chars))))

    def writer(self, schema: StructType, overwrite: bool) -> BibtexWriter:
        return BibtexWriter(dict(self.options)["path"], schema.names, overwrite)


def read_bibtex(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, **options) -> DataFrame:
    """Items of all files at or below a path, with positions, lines and `pos` of their file; as `items`, but for fields' texts.

    Texts of fields are those of their parts without definitions; see `with_definitions`. file_id is the file's URI.
    """
    spark.dataSource.register(BibtexSource)
    source = spark.read.format("bibtex").option("rangeBytes", range_bytes)
    raw = stored(source.options(**options).load(path), "bibtex-ranges")
    before = Window.partitionBy("file_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = {c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in ("chars", "lines", "pos")}
    bases = raw.filter("kind = 'range'").select("file_id", "range", *sums.values())
    rows = raw.filter("kind <> 'range'").join(F.broadcast(bases), ["file_id", "range"])  # one row a range
    moved = lambda c, by: (c + by).cast("int")
    at = F.col("__chars")
    inner = lambda f: F.struct(f["name"].alias("name"), *[moved(f[c], at).alias(c) for c in ("name_start", "name_end", "value_start", "value_end")], *[f[c].alias(c) for c in ("raw", "parts", "text", "unresolved")])
    changed = {c: moved(F.col(c), at) for c in SPANS} | {"pos": moved(F.col("pos"), F.col("__pos")), "line": moved(F.col("line"), F.col("__lines")), "fields": F.transform("fields", inner)}
    return rows.withColumns(changed).drop("range", "chars", "lines", "__chars", "__lines", "__pos")


def write_bibtex(texts: DataFrame, path: str, key_col: str = "key", text_col: str = "text", overwrite: bool = True, order_col: str | None = None) -> None:
    """(key, text) -> a file for each name that `safe_filename` makes of a key; keys with one name share its file, in order of key, of
    the column `order_col`, if one is given, and of text."""
    texts.sparkSession.dataSource.register(BibtexSource)
    order = [F.col(c).alias(f"__{n}") for n, c in enumerate((key_col, order_col)) if c]
    named = texts.select(safe_filename(key_col).alias("file"), *order, F.col(text_col).alias("text"))
    dealt = named.repartition("file").sortWithinPartitions(*[c for c in named.columns if c != "text"], "text").select("file", "text")
    dealt.write.format("bibtex").mode("overwrite" if overwrite else "append").save(path)
