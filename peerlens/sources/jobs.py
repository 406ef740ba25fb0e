"""Jobs that log what they read, wrote and could not write: counts come from the write itself."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

JOBS = "job_id string, job_type string, params map<string,string>, status string, rows_read long, rows_written long, rows_failed long, failed array<struct<key:string,error:string>>, error string, started_at timestamp, finished_at timestamp"
SUCCEEDED, PARTIAL, FAILED = "succeeded", "partial", "failed"
LISTED = 100


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def log_job(spark: SparkSession, row: tuple, path: str) -> None:
    spark.createDataFrame([row], JOBS).coalesce(1).write.mode("append").parquet(path)


def run_job(rows: DataFrame, path: str, *, job_id: str, job_type: str, params: dict[str, str], key: Column, error: Column, log: str, by: tuple[str, ...] = (), listed: int = LISTED) -> str:
    """Write rows under path and append a row to the job log; returns the status.

    error says per row why it can't be taken, null where it can. Good rows go to path/state=ok, the others with their error to
    path/state=failed, in one write: they don't stop the rest. Rows read, written and failed are observed as they pass to
    the writer, so there is no second scan. Status: succeeded, partial where rows failed, failed where the job itself
    did; the log then has the error and the exception is raised again. The log lists `listed` failed keys, the smallest,
    with their errors; all are in path/state=failed. A job of the same id replaces what it wrote before.
    """
    spark, began = rows.sparkSession, _now()
    seen = Observation(f"job-{job_id}")
    checked = rows.withColumn("error", error.cast("string"))
    bad = F.col("error").isNotNull()
    observed = checked.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(bad).alias("failed"))
    out = observed.withColumns({"state": F.when(bad, "failed").otherwise("ok"), "job": F.lit(job_id)})
    try:
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job", "state", *by).parquet(path)
        counts = seen.get
    except Exception as e:
        log_job(spark, (job_id, job_type, params, FAILED, None, None, None, [], str(e)[:2000], began, _now()), log)
        raise
    failed: list = []
    if counts["failed"]:
        # Only what failed is read again, from where it was written.
        again = spark.read.parquet(path).filter((F.col("job") == job_id) & (F.col("state") == "failed")).withColumn("__key", key.cast("string"))
        failed = [(r["__key"], (r["error"] or "")[:500]) for r in again.select("__key", "error").orderBy("__key", "error").limit(listed).collect()]
    status = PARTIAL if counts["failed"] else SUCCEEDED
    log_job(spark, (job_id, job_type, params, status, counts["read"], counts["read"] - counts["failed"], counts["failed"], failed, None, began, _now()), log)
    return status
