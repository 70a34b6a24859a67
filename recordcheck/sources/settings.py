"""Settings that users save: a log of JSON texts, of which each user's last one counts, read with distrust."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordcheck.config import Settings, sanitize_settings
from recordcheck.functions.arrow import arrow_function

SETTINGS = (
    "struct<mode:string,author_format:string,key_scheme:struct<parts:array<string>,separator:string,lowercase:boolean>,latex_accents:boolean,contact_email:string,cache_enabled:boolean,"
    "found_ttl_days:double,absent_ttl_hours:double>"
)


def _sanitized(raw: str | None) -> dict:
    try:
        given = json.loads(raw or "")
    except ValueError:
        given = None
    found = asdict(sanitize_settings(given))
    found["key_scheme"]["parts"] = list(found["key_scheme"]["parts"])
    return found | {"found_ttl_days": float(found["found_ttl_days"]), "absent_ttl_hours": float(found["absent_ttl_hours"])}


#: JSON text to settings; what is not valid, or no JSON, falls back to the defaults.
sanitized = arrow_function(_sanitized, SETTINGS)


def last_settings(log: DataFrame) -> DataFrame:
    """(user, saved_at, raw) -> (user, settings): each user's last ones; of equal times the text that is last in order."""
    last = log.groupBy("user").agg(F.max(F.struct("saved_at", "raw"))["raw"].alias("raw"))
    return last.select("user", sanitized("raw").alias("settings"))


def save_settings(spark: SparkSession, path: str, user: str, settings: Settings) -> None:
    """Appends a user's settings, as they are after sanitizing, to the log at a path."""
    raw = json.dumps(asdict(sanitize_settings(asdict(settings))))
    spark.createDataFrame([(user, raw)], "user string, raw string").withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def load_settings(spark: SparkSession, path: str, user: str) -> Settings:
    """A user's last saved settings; the defaults where none are."""
    found = last_settings(spark.read.parquet(path).filter(F.col("user") == user)).select(F.to_json("settings").alias("s")).first()
    return sanitize_settings(json.loads(found["s"])) if found else Settings()
