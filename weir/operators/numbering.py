"""Numbering rows in an order without bringing them into one task, and cutting long lineages."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART, PLACE, BEFORE = "__weir_part", "__weir_place", "__weir_before"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, as in tests, one of this machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="weir-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if the session is still there."""
    with contextlib.suppress(Exception):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once to that folder and read from there; the files go when the program ends."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/weir-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(dropped, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, name: str, order: list[Column | str], after: DataFrame | None = None) -> DataFrame:
    """Rows with numbers, from 1 or from the one value of ``after`` plus 1, in the order given, which has to be total.

    Rows are dealt by ranges of the order and numbered within each; the ranges' sizes, one row a range, say how many come before."""
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))
    sizes = dealt.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(PART, before.alias(BEFORE))
    if after is not None:
        starts = starts.crossJoin(F.broadcast(after.toDF("__weir_after"))).select(PART, (F.col(BEFORE) + F.col("__weir_after")).alias(BEFORE))
    placed = dealt.withColumn(PLACE, F.row_number().over(Window.partitionBy(PART).orderBy(*order))).join(F.broadcast(starts), PART)
    return placed.withColumn(name, (F.col(BEFORE) + F.col(PLACE)).cast("long")).select(*[c for c in rows.columns if c != name], name)
