"""Incremental forms: file source, watermarked sessions, upsert per micro-batch."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.sinks import upsert

BUCKET, VERSION = "upsert_bucket", "upsert_version"


def stream_table(spark: SparkSession, path: str, like: DataFrame, files: int = 100) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n, value of sessions; the same on a table and on a stream (events later than `late` are
    not waited for)."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "value")


def upsert_stream(rows: DataFrame, path: str, keys: list[str], update: list[str], order: str, checkpoint: str, *, buckets: int = 64) -> StreamingQuery:
    """Keep the latest row per key, in hash buckets of the keys; latest_rows reads the table.

    A batch writes path/upsert_bucket=<bucket>/upsert_version=<batch> for the buckets that its keys fall into, each from that bucket's version
    before, and leaves all others alone. A batch that is run again starts from the same versions and writes the same
    ones. Versions are files of their own, so readers of older ones aren't disturbed; they are not removed here.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = sorted(r[BUCKET] for r in placed.select(BUCKET).distinct().collect())  # at most `buckets` rows
        if not touched:
            return
        old = _versions(spark, path, placed, number)
        base = old.filter(F.col(BUCKET).isin(touched)).drop(VERSION) if old is not None else placed.limit(0)
        merged = upsert(base.select(placed.columns), placed, [BUCKET, *keys], update, F.col(order)).withColumn(VERSION, F.lit(number))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, VERSION).parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, like: DataFrame, before: int | None = None) -> DataFrame | None:
    """Rows of each bucket's newest version (of those before a batch), with bucket and version; None without any."""
    schema = StructType([f for f in like.schema.fields if f.name not in (BUCKET, VERSION)] + [StructField(c, IntegerType()) for c in (BUCKET, VERSION)])
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rows = rows if before is None else rows.filter(F.col(VERSION) < before)
    # Partition values alone: the files' footers tell that a version has rows.
    newest = {r["b"]: r["v"] for r in rows.groupBy(F.col(BUCKET).alias("b")).agg(F.max(VERSION).alias("v")).collect()}  # a row per bucket
    if not newest:
        return None
    return rows.filter(reduce(lambda a, c: a | c, [(F.col(BUCKET) == b) & (F.col(VERSION) == v) for b, v in sorted(newest.items())]))


def latest_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table that upsert_stream keeps: the newest version of every bucket."""
    rows = _versions(spark, path, like)
    return like.limit(0) if rows is None else rows.select(like.columns)
