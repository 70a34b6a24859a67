"""Requests that are asked again: once after a refusal, and once in the way that a source is known to need.

A request has at most four tries: two rounds, each of at most two. A round's second try follows a refusal (429) after a wait. The
second round depends on the source: a search that Crossref does not accept is asked without its list of fields, and DBLP, which
answers overload with a page, is asked again. Each step asks for what is left, so an answered request meets no further join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordcheck.sources.cache import retry_wait_ms
from recordcheck.sources.lookups import json_problem, json_status, response_status
from recordcheck.storage import stored

# Characters read of a body, milliseconds before DBLP is asked again, and the source that answers in XML.
BODY_CHARS = 3_000_000
PAGE_WAIT_MS = 800
XML_SOURCES = ("arXiv",)

#: (request_id, source, operation, round, try) -> (request_id, http int, body, retry_after, offline boolean).
Ask = Callable[[DataFrame], DataFrame]
ANSWER = "request_id, http, body, retry_after, offline"


def asked_seconds(header: str | Column) -> Column:
    """Seconds of a Retry-After header: none where it is missing or blank, null (unknown) where it is no number."""
    header = F.col(header) if isinstance(header, str) else header
    number = F.trim(header).try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(F.coalesce(F.trim(header), F.lit("")) == "", F.lit(0.0)).when(finite, number)


def judged_answers(answers: DataFrame) -> DataFrame:
    """(source, http, body, offline, ...) with status, detail and the body's first 3,000,000 characters."""
    rows = answers.withColumn("body", F.left("body", F.lit(BODY_CHARS)))
    xml = F.col("source").isin(*XML_SOURCES)
    plain = response_status("http", F.coalesce("offline", F.lit(False)))
    status = F.when(plain != "OK", plain).when(xml, plain).otherwise(json_status("http", F.coalesce("body", F.lit(""))))
    code = F.when(F.col("http") >= 400, F.concat(F.lit("HTTP "), F.col("http").cast("string")))
    page = F.when((plain == "OK") & ~xml, json_problem("http", F.coalesce("body", F.lit(""))))
    none = F.when(F.col("http").isNull(), F.when(plain == "NETWORK UNAVAILABLE", F.lit("Offline")).otherwise(F.lit("No answer")))
    return rows.withColumns({"status": status, "detail": F.coalesce(code, page, none)})


def next_try() -> Column:
    """Of a judged answer: struct (round, try, wait_ms) of what is to be asked next; null where the answer stands."""
    step = lambda round_, try_, wait: F.struct(round_.cast("int").alias("round"), F.lit(try_).alias("try"), wait.cast("bigint").alias("wait_ms"))
    refused = (F.col("status") == "RATE LIMITED") & (F.col("try") == 1)
    search = (F.col("round") == 1) & (F.col("operation") == "search")
    fields = search & (F.col("source") == "Crossref") & (F.col("http") == 400)
    page = search & (F.col("source") == "DBLP") & (F.col("status") == "LOOKUP FAILED") & (F.col("http") < 400)
    return (
        F.when(refused, step(F.col("round"), 2, retry_wait_ms(asked_seconds("retry_after"))))
        .when(fields, step(F.lit(2), 1, F.lit(0)))
        .when(page, step(F.lit(2), 1, F.lit(PAGE_WAIT_MS)))
    )


def ask_again(requests: DataFrame, ask: Ask) -> DataFrame:
    """(request_id, source, operation) -> (request_id, status, detail, http, body, round, try, asked, waited_ms): the answer that stands.

    `asked` counts tries and `waited_ms` sums the waits before them; pacing between requests is apart. A try that `ask`
    returns no row for counts as failed. request_id should be distinct; a request with a null one is failed, once. A null
    source or operation has no second round. Columns of `requests` other than the three are left out.
    """
    start = requests.select("request_id", "source", "operation").withColumns({"round": F.lit(1), "try": F.lit(1), "asked": F.lit(0), "waited_ms": F.lit(0).cast("bigint")})
    wanted, settled = stored(start, "requests"), None
    for _ in range(4):
        answers = ask(wanted.select("request_id", "source", "operation", "round", "try")).selectExpr(*ANSWER.split(", "))
        judged = judged_answers(wanted.join(answers, "request_id", "left")).withColumn("asked", F.col("asked") + 1)
        judged = stored(judged.withColumn("next", next_try()), "request-answers")
        done = judged.filter("next IS NULL").select("request_id", "status", "detail", "http", F.when(F.col("status") == "OK", F.col("body")).alias("body"), "round", "try", "asked", "waited_ms")
        settled = done if settled is None else settled.unionByName(done)
        left = judged.filter("next IS NOT NULL")
        if left.limit(1).count() == 0:
            break
        wanted = left.select("request_id", "source", "operation", "next.round", "next.try", "asked", (F.col("waited_ms") + F.col("next.wait_ms")).alias("waited_ms"))
    return settled


def recorded(answers: DataFrame) -> Ask:
    """Asks a table of recorded answers (request_id, round, try, http, body, retry_after, offline)."""
    return lambda wanted: wanted.select("request_id", "round", "try").join(answers, ["request_id", "round", "try"]).selectExpr(*ANSWER.split(", "))
