"""Answers remembered for a while, and requests kept apart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordcheck.config import ABSENT_TTL_S, DEFAULT_GAP_MS, FOUND_TTL_S, HOST_GAP_MS

PREFIX = "cache:"


def cache_key(source: str, operation: str, query: str | Column) -> Column:
    """Searches are keyed by a digest of their parameters, identifiers by themselves in lower case."""
    query = F.col(query) if isinstance(query, str) else query
    tail = F.sha2(query, 256) if operation.startswith("search") else F.lower(query)
    return F.concat(F.lit(f"{PREFIX}{source}:{operation}:"), tail)


def lifetime(status: str | Column, found_s: float = FOUND_TTL_S, absent_s: float = ABSENT_TTL_S) -> Column:
    """Seconds that an answer is kept; null for failures, which never are."""
    status = F.col(status) if isinstance(status, str) else status
    return F.when(status == "OK", float(found_s)).when(status == "NO RECORD FOUND", float(absent_s))


def cache_fold(ats: list[float], ttls: list[float | None]) -> list[bool]:
    """Which requests of one key, in time order, an earlier answer serves; ttls are those of the answers they would fetch."""
    hits, until = [], float("-inf")
    for at, ttl in zip(ats, ttls):
        hits.append(at < until)
        if not hits[-1] and ttl is not None and ttl == ttl:
            until = at + ttl  # the lifetime is kept with the answer
    return hits


def replay_cache(requests: DataFrame, found_s: float = FOUND_TTL_S, absent_s: float = ABSENT_TTL_S) -> DataFrame:
    """(key, at seconds, request_id, status that a fetch would have) -> the same with from_cache.

    Within one key a request depends on the last fetch before it, which no window function can express: each key's requests
    are folded in order. Requests of one key are few next to all; ties in time are taken by request_id.
    """
    rows = requests.withColumn("ttl", lifetime("status", found_s, absent_s))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "request_id"])
        return group.drop(columns="ttl").assign(from_cache=cache_fold(group["at"].tolist(), group["ttl"].tolist()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return rows.groupBy("key").applyInPandas(fold, f"{ddl}, from_cache boolean")


def clear_cache(store: DataFrame) -> DataFrame:
    """A key-value store without the cached answers."""
    return store.filter(~F.col("key").startswith(PREFIX))


def host_gap(host: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in HOST_GAP_MS.items() for x in kv])
    return F.coalesce(F.element_at(table, F.col(host) if isinstance(host, str) else host), F.lit(DEFAULT_GAP_MS))


def paced_starts(requests: DataFrame, order: tuple[str, ...] = ("arrival", "request_id")) -> DataFrame:
    """(host, arrival, service, gap) -> with start: requests of a host run one by one, a gap after the end of the last.

    start_i = max(arrival_i, start_{i-1} + service_{i-1} + gap) is a running maximum, once the time that earlier requests
    need is taken off: a window, not a loop.
    """
    run = Window.partitionBy("host").orderBy(*order)
    need = F.coalesce(F.sum(F.col("service") + F.col("gap")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = requests.withColumn("need", need)
    latest = F.max(F.col("arrival") - F.col("need")).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("start", latest + F.col("need")).drop("need")


def retry_wait_ms(retry_after_s: str | Column) -> Column:
    """Milliseconds before the one retry after a refusal: what was asked for, between one and five seconds, two by default."""
    wait = F.coalesce(F.col(retry_after_s) if isinstance(retry_after_s, str) else retry_after_s, F.lit(2))
    return F.least(F.lit(5000), F.greatest(F.lit(1000), wait * 1000))
