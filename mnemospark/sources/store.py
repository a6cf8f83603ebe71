"""Files of the store: the memory document, the day-partitioned archive, the ledger, CSV label sheets, frames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators.store import coerce_records
from .schemas import ARCHIVE, RAW_MEMORY


def read_memories(spark: SparkSession, path: str, now_ms: int) -> tuple[DataFrame, bool]:
    """Memories of a JSON document ``{"records": [...]}`` and whether it could be read (S1): a missing one is an empty
    store, a corrupt one is too and is kept aside as ``<path>.corrupt-<now_ms>``."""
    if not _file_system(spark, path)[0].exists(_file_system(spark, path)[1]):
        return coerce_records(spark.createDataFrame([], RAW_MEMORY), now_ms), True
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(f"records array<struct<{', '.join(f'{n}: {t}' for n, t in _fields(RAW_MEMORY))}>>, _corrupt_record string").json(path)
    healthy = raw.filter("records is null").limit(1).count() == 0
    if not healthy:
        files, at = _file_system(spark, path)
        files.rename(at, spark._jvm.org.apache.hadoop.fs.Path(f"{path}.corrupt-{now_ms}"))
        return coerce_records(spark.createDataFrame([], RAW_MEMORY), now_ms), False
    return coerce_records(raw.filter("records is not null").select(F.inline("records")), now_ms), healthy


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _fields(schema: str) -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema).fields]


def write_memories(memories: DataFrame, path: str) -> None:
    """Write a new version newest first and point at it last, so a reader never sees half a store."""
    version = f"{path}/v-{uuid.uuid4().hex}"
    memories.orderBy(F.col("created_at").desc(), "id").write.json(version)
    memories.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")


def current_version(spark: SparkSession, path: str) -> str:
    """The folder of the newest complete version."""
    return spark.read.schema("version string").json(f"{path}/current").first().version


def append_ledger(lines: DataFrame, path: str) -> None:
    """Append ledger lines ``(t, kind, ...)`` as JSON."""
    lines.write.mode("append").json(path)


def append_archive(rows: DataFrame, path: str) -> None:
    """Append messages by UTC day of ``at``."""
    rows.withColumn("day", T.iso_date("at")).write.mode("append").partitionBy("day").json(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARCHIVE + ", day string").json(path)


def archive_tail(archive: DataFrame, days: int = 7, rows: int = 2000) -> DataFrame:
    """The newest ``rows`` messages of the newest ``days`` days that exist (S5, ST3): partitions are pruned by a literal
    list of days, then a top-k."""
    found = [r.day for r in archive.select("day").distinct().orderBy(F.col("day").desc()).limit(days).collect()]
    return archive.filter(F.col("day").isin(found or [""])).orderBy(F.col("at").desc(), F.col("session_id").desc(), F.col("seq").desc()).limit(rows)


def forget_archive(spark: SparkSession, path: str, address: str) -> int:
    """Delete one message ``l0:<session>:<seq>`` by rewriting only its days (S9); returns how many rows went."""
    archive = read_archive(spark, path)
    hit = T.archive_id("session_id", "seq") == address
    days = [r.day for r in archive.filter(hit).select("day").distinct().collect()]
    if not days:
        return 0
    touched = archive.filter(F.col("day").isin(days))
    n = touched.filter(hit).count()
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    touched.filter(~hit).write.partitionBy("day").json(staged)
    kept = spark.read.schema(ARCHIVE + ", day string").json(staged)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").json(path)
    return n


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A label sheet: header, quoted cells over several lines, doubled quotes, blank rows dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema(schema).csv(path)
    return rows.filter(F.coalesce(*[F.col(c) for c in rows.columns]).isNotNull())


def write_labels(rows: DataFrame, path: str) -> None:
    """A label sheet that ``read_labels`` gives back."""
    rows.coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", False).option("emptyValue", "").mode("overwrite").csv(path)


def frame(row: DataFrame, path: str) -> None:
    """One nested row as a JSON snapshot."""
    row.coalesce(1).write.mode("overwrite").json(path)


def vector_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached vectors ``(key, embedding)``, of each key the one written last (by file time, then place in the file),
    without empty or non-numeric ones (S15)."""
    rows = spark.read.parquet(path).select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index").alias("_at"))
    rows = rows.filter((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    newest = Window.partitionBy("key").orderBy(F.col("_at").desc())
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_at")
