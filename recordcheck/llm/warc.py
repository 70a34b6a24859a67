"""WARC archives with revisit records in place of repeated payloads.

Headers (id, digest, size) are shuffled by payload digest to name one response of each repeated payload; archives are then
written with fresh headers, a revisit record pointing at its response. Reading resolves revisits back to the responses.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordcheck.llm.common import fresh_path, materialize, table

#: Payload bytes from which a repeated payload becomes a revisit.
REVISIT_BYTES = 1000
#: Bytes of an archive file after which a task begins the next.
FILE_BYTES = 256 << 20
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    """A URN that depends on page and payload alone, so that a task that runs twice writes the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _lines(first: str, headers: list[tuple[str, str]]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {' '.join(v.split())}" for k, v in headers), "", ""]).encode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, a gzip member of its own; a revisit keeps the HTTP headers and leaves out the payload."""
    http = _lines("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", url)] if url else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Page-ID", str(page_id))] if page_id is not None else []),
        *([("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Profile", PROFILE)] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return gzip.compress(_lines(VERSION, headers) + block + b"\r\n\r\n", 6, mtime=0)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip-compressed archive, one in memory at a time."""
    with gzip.GzipFile(fileobj=stream, mode="rb") as f:
        while True:
            line = f.readline()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {line[:40]!r}")
            headers = {}
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
                headers[name.strip().lower()] = value.strip()
            size = int(headers["content-length"])
            block = f.read(size)
            if len(block) != size or f.read(4) != b"\r\n\r\n":
                raise ValueError("a record ends early")
            yield headers, block


def _write(base: str, file_bytes: int):
    """Rows (part, page_id, url, html, digest, refers_to) -> archives; a file appears only when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        out, part, count, rows, size = None, 0, 0, 0, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal out, count, rows, size
            out.close()
            name = f"part-{part:06d}-{count:04d}.warc.gz"
            store.move(temp, f"{root}/{name}")
            done.append((f"{base}/{name}", rows))
            out, count, rows, size = None, count + 1, 0, 0

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    part = r["part"]
                    temp = f"{root}/.{part:06d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temp)
                payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                got = record(r["page_id"], r["url"], payload, r["digest"], r["refers_to"])
                out.write(got)
                rows, size = rows + 1, size + len(got)
                if size >= file_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_type", "record_id", "refers_to_id", "page_id", "url", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for b in batches:
        for path in b.column(0).to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with store.open_input_stream(name, compression=None) as stream:
                for head, block in records(stream):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {head['warc-record-id']} doesn't have its digest")
                    page = head.get("warc-page-id")
                    rows.append((head["warc-type"], head["warc-record-id"], head.get("warc-refers-to"), None if page is None else int(page), head.get("warc-target-uri"), digest, None if revisit else len(payload), None if revisit else payload))
                    held += len(payload)
                    if held > 16 << 20 or len(rows) >= 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def choose_responses(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) -> with digest, payload_bytes and refers_to (null: a response).

    Of equal payloads of at least `least` bytes, the one with the largest page_id is the response. Null html is an empty
    payload. Rows that repeat the largest page_id of their payload are all responses, as is a row without a page_id.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("bigint").alias("payload_bytes"))
    heads = rows.filter(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    repeated = materialize(heads.filter("n > 1 AND last IS NOT NULL").select("digest", "payload_bytes", "last"), "warc-repeated")
    joined = rows.join(repeated, ["digest", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("last"), F.col("last"))).drop("last")


def write_archives(pages: DataFrame, base: str, least: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write deduplicated archives below `base` and return their stored list (path, records)."""
    chosen = choose_responses(pages, least).select(F.spark_partition_id().alias("part"), "page_id", "url", "html", "digest", "refers_to")
    return materialize(chosen.mapInArrow(_write(base, file_bytes), "path string, records bigint"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """Stored (path) -> a row for each record, payloads checked against their digests; revisits have no payload yet.

    Each file is read by a task of its own; an empty list gives no rows."""
    schema = "record_type string, record_id string, refers_to_id string, page_id bigint, url string, payload_digest string, payload_bytes bigint, payload binary"
    return files.select("path").repartition(max(1, files.count())).mapInArrow(_read, schema)  # a given number isn't coalesced


def resolve_revisits(read: DataFrame) -> DataFrame:
    """Records -> with payload_bytes of the response that a revisit refers to, and that response's page as refers_to.

    `read` should be stored: responses and revisits are read apart. Only headers are joined; a revisit whose response is
    missing keeps nulls.
    """
    heads = read.drop("payload", "payload_bytes")
    whole = read.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("__bytes")).dropDuplicates(["refers_to_id"])
    responses = read.filter("record_type = 'response'").drop("payload").withColumn("refers_to", F.lit(None).cast("bigint"))
    targets = materialize(whole, "warc-responses")
    revisits = heads.filter("record_type = 'revisit'").join(targets, "refers_to_id", "left")
    return responses.unionByName(revisits.withColumnRenamed("__bytes", "payload_bytes"))


def op1_warc(spark, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    heads = materialize(read_archives(files).drop("payload"), "warc-heads")
    found = resolve_revisits(heads.withColumn("payload", F.lit(None).cast("binary")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p
)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM g
"""
