"""Tables laid out by day: written by stream batches, read from a time on, and rid of what is too old."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.operators.numbering import checkpointed, dropped

#: Days for which tables are kept, and the least time between two cleanings.
KEPT_DAYS = {"worker_log": 14, "worker_metric": 30}
EVERY = dt.timedelta(minutes=30)


def append_batch(rows: DataFrame, path: str, time: str, number: int) -> None:
    """Writes a batch below its rows' days.  A batch that is run again writes its own folders again, and no others."""
    by_day(rows.withColumn("day", F.to_date(time)).withColumn("batch", F.lit(number)), path)


def by_day(rows: DataFrame, path: str) -> None:
    """Replaces the folders (day, batch) that rows have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()) if fs.exists(folder) else []


def since(spark: SparkSession, path: str, start: dt.datetime, time: str = "created_at") -> DataFrame:
    """Rows from a time on; folders of earlier days are not read."""
    at = F.lit(start).cast("timestamp")
    return spark.read.parquet(path).where((F.col("day") >= F.lit(start.date())) & (F.col(time).cast("timestamp") >= at))


def expire(spark: SparkSession, path: str, now: dt.datetime, days: int, time: str = "created_at") -> list[str]:
    """Takes rows older than so many days out of a table by day; the names of the days that were dropped or written again.

    Earlier days are dropped without being read.  The day that the border lies in is the only one read: its folders are replaced by
    what is left of them.  Rows without a time, which lie in no day, stay."""
    cut = now - dt.timedelta(days=days)
    named = {n.removeprefix("day="): n for n in folders(spark, path) if n.startswith("day=")}
    gone = [d for d in named if d < cut.date().isoformat()]
    for d in gone:
        dropped(spark, f"{path}/{named[d]}")
    border = cut.date().isoformat()
    if border not in named or cut.time() == dt.time(0):
        return gone
    left = checkpointed(since(spark, path, cut, time).where(F.col("day") == F.lit(cut.date())))
    kept = {f"batch={r[0]}" for r in left.select("batch").distinct().collect()}
    by_day(left, path)
    for b in folders(spark, f"{path}/{named[border]}"):
        if b not in kept:
            dropped(spark, f"{path}/{named[border]}/{b}")
    return [*gone, border]


def clean(spark: SparkSession, out: str, now: dt.datetime, last: dt.datetime | None = None, kept_days: dict[str, int] | None = None) -> dt.datetime | None:
    """Expires each of the tables below out, unless that was done so recently; when it was done last."""
    if last is not None and now - last < EVERY:
        return last
    for name, days in (kept_days or KEPT_DAYS).items():
        expire(spark, f"{out}/{name}", now, days)
    return now
