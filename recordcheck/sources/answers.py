"""A Spark data source for stored answers of metadata services, with filters on their keys pushed down.

Answers are kept as Parquet in one folder for each bucket of their key (`write_answers`). A filter that compares `key` with values,
as DOIs and arXiv ids are looked up, is pushed: only the buckets of those values are planned as partitions, and only row groups that may hold
them are read. Filters on `source` are pushed to the rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from recordcheck.schema import WORK
from recordcheck.sources.lookups import SnapshotSource, json_status, response_status
from recordcheck.sources.payloads import with_work
from recordcheck.storage import stored

COLUMNS = "source string, key string, http int, body string"
BUCKETS = 64
#: Keys up to which a lookup is a filter with values; more are joined.
PUSHED_KEYS = 2000


def bucket_of(key: str, buckets: int) -> int:
    return zlib.crc32(key.encode()) % buckets


def write_answers(answers: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """(source, key, http, body) -> a folder for each bucket of keys; rows without a key are no answers."""
    keyed = answers.filter("key IS NOT NULL").select("source", "key", F.col("http").cast("int").alias("http"), "body")
    placed = keyed.withColumn("bucket", F.pmod(F.crc32(F.encode("key", "UTF-8")), F.lit(buckets)).cast("int"))
    # A bucket with a large share is written by several tasks; keys are sorted, so that row groups have narrow ranges.
    placed.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(path)


@dataclass
class Bucket(InputPartition):
    number: int

    def __init__(self, number: int):
        self.number = number


class AnswersReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, buckets: int):
        self.schema, self.path, self.buckets = schema, path.rstrip("/"), buckets
        self.keys: set[str] | None = None
        self.sources: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of key and source with values; the others are left to Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if not isinstance(f, (EqualTo, In)) or column not in (("key",), ("source",)):
                yield f
                continue
            values = {v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
            name = "keys" if column == ("key",) else "sources"
            known = getattr(self, name)
            setattr(self, name, values if known is None else known & values)

    def partitions(self) -> list[Bucket]:
        numbers = range(self.buckets) if self.keys is None else sorted({bucket_of(k, self.buckets) for k in self.keys})
        return [Bucket(n) for n in numbers]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no bucket is asked for
            return
        store, root = fs.FileSystem.from_uri(self.path)
        folder = f"{root}/bucket={partition.number}"
        if store.get_file_info(folder).type != fs.FileType.Directory:
            return
        wanted = None
        for column, values in (("key", self.keys), ("source", self.sources)):
            if values is not None:
                test = ds.field(column).isin(sorted(values))
                wanted = test if wanted is None else wanted & test
        found = ds.dataset(folder, format="parquet", filesystem=store)
        yield from found.to_batches(columns=self.schema.names, filter=wanted)


class AnswersSource(DataSource):
    """Options: path, and buckets as it was written with."""

    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> AnswersReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return AnswersReader(schema, options["path"], int(options.get("buckets", BUCKETS)))


def read_answers(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """(source, key, http, body); filters on key and source are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AnswersSource)
    return spark.read.format("answers").option("buckets", buckets).load(path)


@dataclass(frozen=True)
class AnswersLookup:
    """A `Source` over stored answers of one service, asked for the keys that are wanted and no others.

    Up to `pushed` distinct keys are a pushed filter; beyond that the answers are joined. Works of titles are not searched.
    """

    spark: SparkSession
    name: str
    path: str
    by_doi: bool = True
    buckets: int = BUCKETS
    pushed: int = PUSHED_KEYS

    def answers(self, keys: DataFrame) -> DataFrame:
        """(key) -> the rows of this service that may answer; all of them where the keys are many."""
        found = read_answers(self.spark, self.path, self.buckets).filter(F.col("source") == self.name)
        asked = [r["key"] for r in keys.filter("key IS NOT NULL").distinct().limit(self.pushed + 1).collect()]
        return found if len(asked) > self.pushed else found.filter(F.col("key").isin(asked) if asked else F.lit(False))

    def works(self, rows: DataFrame) -> DataFrame:
        """(key, http, body) -> (key, status, work) as the service's mapper reads them."""
        status: Column = response_status("http") if self.name == "arXiv" else json_status("http", "body")
        mapped = with_work(rows.withColumn("status", status), self.name, F.col("body"), work="work")
        gone = F.when((F.col("status") == "OK") & F.col("work").isNull(), F.lit("NO RECORD FOUND")).otherwise(F.col("status"))
        return mapped.select("key", gone.alias("status"), F.when(F.col("status") == "OK", F.col("work")).cast(WORK).alias("work"))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        wanted = stored(wanted.select("citation_id", "doi_key"), "answers-wanted")
        rows = self.answers(wanted.select(F.col("doi_key").alias("key")))
        found = self.works(rows).withColumnRenamed("key", "doi_key")
        return SnapshotSource(self.name, found, found, self.by_doi).lookup(wanted)
