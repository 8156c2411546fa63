"""An idempotent sink for at-least-once input: data first, then one line of a ledger that makes it count.

A micro-batch is written to a folder of its own that no reader looks into until the ledger names it. So a run that stops
between data and ledger leaves nothing visible, and the batch that comes again writes anew. A batch whose number the ledger
has was done before and is skipped; rows that come again in another batch are told by their keys, which are looked up
only in the days that the batch touches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LINE = "batch long, folder string, n long, digest string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; empty before its first line."""
    try:
        return spark.read.schema(LINE).parquet(f"{path}/ledger")
    except AnalysisException:
        return spark.createDataFrame([], LINE)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows that count: those of the folders that the ledger names."""
    folders = [r.folder for r in _lines(spark, path).select("folder").toLocalIterator()]
    if not folders:
        return spark.createDataFrame([], f"{schema}, day string" if schema else "day string")
    reader = spark.read.option("basePath", f"{path}/data")
    return (reader.schema(f"{schema}, folder string, day string") if schema else reader).parquet(*(f"{path}/data/folder={f}" for f in folders)).drop("folder")


def digest(rows: DataFrame, *key: str) -> tuple[int, str]:
    """Number and an order-free digest of a batch's keys."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*key).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return n, f"{n}:{total}"


def sink(path: str, time: str, *key: str, between: Callable[[int], None] = lambda batch: None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: appends each key once, under the day of column `time`.

    between: called with the batch's number between data and ledger (tests stop a run there).
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        lines = _lines(spark, path)
        if not lines.where(F.col("batch") == batch).isEmpty():
            return
        n, told = digest(rows, *key)
        if not n:
            return
        folder = uuid.uuid4().hex
        dated = rows.dropDuplicates(list(key)).withColumn("day", F.date_format(time, "yyyy-MM-dd"))
        known = read(spark, path)
        if known.columns != ["day"]:
            # As many days as a batch has: readers prune all other folders.
            days = [r.day for r in dated.select("day").distinct().toLocalIterator()]
            dated = dated.join(known.where(F.col("day").isin(days)).select(*key), list(key), "left_anti")
        dated.write.partitionBy("day").parquet(f"{path}/data/folder={folder}")
        between(batch)
        spark.createDataFrame([(batch, folder, n, told)], LINE).coalesce(1).write.mode("append").parquet(f"{path}/ledger")

    return write

