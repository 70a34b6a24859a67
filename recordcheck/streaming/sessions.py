"""Streaming forms of the operators that keep state over time: remembered answers, runs that supersede others, progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recordcheck.config import ABSENT_TTL_S, FAILURES, FOUND_TTL_S
from recordcheck.sources.cache import cache_fold, lifetime

#: Age after which a text handed over is no longer taken.
HANDOVER_S = 300


def stream_cache(requests: DataFrame, found_s: float = FOUND_TTL_S, absent_s: float = ABSENT_TTL_S) -> DataFrame:
    """A stream (key, at seconds, request_id, status) -> with from_cache.

    A key's state is the second until which its last answer holds. Requests of a batch are folded in time order, and state
    that has run out goes by itself.
    """
    rows = requests.withColumn("ttl", lifetime("status", found_s, absent_s))
    longest_ms = int(max(found_s, absent_s) * 1000)

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"])
        fresh = rows["at"] >= until
        hits = [True] * int((~fresh).sum()) + cache_fold(rows.loc[fresh, "at"].tolist(), rows.loc[fresh, "ttl"].tolist())
        for at, ttl, hit in zip(rows["at"], rows["ttl"], hits):
            if not hit and ttl == ttl and ttl is not None:
                until = at + ttl
        state.update((until,))
        state.setTimeoutDuration(longest_ms)
        yield pd.DataFrame({"key": rows["key"], "at": rows["at"], "request_id": rows["request_id"], "status": rows["status"], "from_cache": hits})

    out = "key string, at double, request_id long, status string, from_cache boolean"
    typed = rows.select(F.col("key").cast("string").alias("key"), F.col("at").cast("double").alias("at"), F.col("request_id").cast("long").alias("request_id"), "status", "ttl")
    return typed.groupBy("key").applyInPandasWithState(fold, out, "until double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_run(results: DataFrame) -> DataFrame:
    """A stream (entry_id, token, result) -> the result of each entry's latest run; late results of earlier runs are dropped.

    Kept by aggregation (complete or update mode), so that it holds across batches.
    """
    return results.groupBy("entry_id").agg(F.max("token").alias("token"), F.max_by("result", "token").alias("result"))


def handed_over(texts: DataFrame, now: str = "now") -> DataFrame:
    """Texts (at, now, text) that were handed over within five minutes and are of a size that is read."""
    age = F.unix_micros(F.col(now).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    return texts.filter(age.between(0, HANDOVER_S * 1_000_000) & (F.char_length("text") <= 5_000_000))


def progress(statuses: DataFrame, every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """A stream (at, source, status) -> counts for each window and source: asked, answered, failed."""
    failed = F.col("status").isin(*FAILURES)
    windows = statuses.withWatermark("at", late).groupBy(F.window("at", every).alias("w"), "source")
    counted = windows.agg(F.count("*").alias("asked"), F.count_if(F.col("status") == "OK").alias("answered"), F.count_if(failed).alias("failed"))
    return counted.select(F.col("w.start").alias("start"), "source", "asked", "answered", "failed")
