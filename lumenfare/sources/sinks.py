"""Sinks on plain Parquet: idempotent append, insert-or-ignore, counters, monthly partitions, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(rows: DataFrame, existing: DataFrame, *key: str) -> DataFrame:
    """Rows whose key is neither there nor repeated: appending them twice changes nothing."""
    return rows.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def append_observations(rows: DataFrame, path: str) -> None:
    """Append by month of checked_at; the month is a directory, so that readers and retention prune by it."""
    rows.withColumn("month", F.date_format("checked_at", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def merge_counts(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Counters (n, first_at, last_at) of old and new, summed for each key."""
    return old.unionByName(new).groupBy(*key).agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def upsert_months(spark: SparkSession, path: str, rows: DataFrame, time: str, *key: str, newest: str) -> None:
    """Insert rows or replace those of their keys, copying only the months that rows touch.

    Of rows with one key, old or new, that of the largest `newest` stays; a key stays in its month, so it has to hold what
    fixes `time`. Months are directories: those that no row touches are neither read nor written. New files replace old ones
    as the job commits, so a run that stops before leaves the table as it was.
    """
    dated = rows.withColumn("month", F.date_format(time, "yyyy-MM"))
    # As many values as months: what readers prune by.
    months = [r.month for r in dated.select("month").distinct().toLocalIterator()]
    there = spark.read.parquet(path).where(F.col("month").isin(months)).withColumn("month", F.col("month").cast("string")) if months_of(spark, path) else dated.limit(0)
    every = there.unionByName(dated)
    last = F.max_by(F.struct(*every.columns), F.struct(newest, F.xxhash64(*every.columns))).alias("r")
    one = every.groupBy(*key).agg(last).select("r.*")
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def _folder(spark: SparkSession, path: str):
    """A folder of any store that Spark reads, by its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def months_of(spark: SparkSession, path: str) -> list[str]:
    """The months that a table has directories for, in order; none where there is no table."""
    store, at = _folder(spark, path)
    if not store.exists(at):
        return []
    names = [f.getPath().getName() for f in store.listStatus(at) if f.isDirectory()]
    return sorted(n.removeprefix("month=") for n in names if n.startswith("month="))


def expire_months(spark: SparkSession, path: str, now: str, months: int = 24) -> list[str]:
    """Drop the directories of months older than the retention, told by their names alone; which they were."""
    cut = spark.range(1).select(F.date_format(F.add_months(F.trunc(F.lit(now).cast("date"), "MM"), -months), "yyyy-MM")).first()[0]
    store, _ = _folder(spark, path)
    gone = [m for m in months_of(spark, path) if m < cut]
    for m in gone:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/month={m}"), True)
    return gone


def within_retention(rows: DataFrame, now: str, months: int = 24) -> DataFrame:
    """Rows of the months that are kept: a filter on the partition column, so older directories are never opened."""
    cut = F.date_format(F.add_months(F.trunc(F.lit(now).cast("date"), "MM"), -months), "yyyy-MM")
    return rows.where(F.col("month") >= cut)


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad rows of a frame with an `error` column."""
    return rows.where("error is null").drop("error"), rows.where("error is not null")
