"""Runs and their files: a log row from metrics observed as rows are written, and pruning of files by their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .sinks import _folder

#: A run's log row.
RUN = "run_id string, triggered_by string, started_at timestamp, finished_at timestamp, status string, offers long, available long, priced long, cheapest double, error_summary string"


def write_with_log(offers: DataFrame, path: str, log: str, run_id: str, triggered_by: str, started_at: object, finished_at: object) -> dict:
    """Append offers (is_available, price, ...) and then the run's row; its figures are observed in the pass that writes.

    Status is success, partial where no available offer has a price, and empty without offers; a run whose write fails gets
    a failed row with the error's text and raises. A run that is in the log already is left alone: it is not written again.
    """
    spark = offers.sparkSession
    known = runs(spark, log).where(F.col("run_id") == run_id).collect()
    if known:
        return known[0].asDict()
    seen = Observation(f"run {run_id}")
    priced = F.col("is_available") & F.col("price").isNotNull()
    observed = offers.observe(seen, F.count("*").alias("offers"), F.count_if("is_available").alias("available"), F.count_if(priced).alias("priced"), F.min(F.when(priced, F.col("price").cast("double"))).alias("cheapest"))
    row = {"run_id": run_id, "triggered_by": triggered_by, "started_at": started_at, "finished_at": finished_at, "status": "failed", "offers": None, "available": None, "priced": None, "cheapest": None, "error_summary": None}
    try:
        observed.write.mode("append").parquet(path)
    except Exception as error:
        _log(spark, log, row | {"error_summary": str(error)[:500]})
        raise
    row |= seen.get
    row["status"] = "empty" if not row["offers"] else "partial" if row["available"] and not row["priced"] else "success"
    _log(spark, log, row)
    return row


def _log(spark: SparkSession, log: str, row: dict) -> None:
    names = [c.split()[0] for c in RUN.split(", ")]
    spark.createDataFrame([tuple(row[n] for n in names)], RUN).coalesce(1).write.mode("append").parquet(log)


def runs(spark: SparkSession, log: str) -> DataFrame:
    """The log; empty before its first row."""
    store, at = _folder(spark, log)
    return spark.read.schema(RUN).parquet(log) if store.exists(at) else spark.createDataFrame([], RUN)


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, modified_at, bytes) of a folder's files, from a scan of their metadata: no file is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("_metadata.file_name").alias("name"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes"))


def prunable(files: DataFrame, errors: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """files past their retention that no unresolved error (artifact: the file's name, resolved_at) refers to."""
    old = files.where(F.col("modified_at") < now - F.make_dt_interval(F.lit(days)))
    wanted = errors.where("resolved_at is null and artifact is not null").select(F.col("artifact").alias("name")).distinct()
    return old.join(wanted, "name", "left_anti")


def prune(files: DataFrame) -> int:
    """Delete the files, each by its store; how many went. A file that is gone already does no harm."""
    spark, n = files.sparkSession, 0
    for r in files.select("path").toLocalIterator():
        store, at = _folder(spark, r.path)
        n += bool(store.delete(at, False))
    return n
