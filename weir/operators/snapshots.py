"""Snapshots kept by the buckets of their key, so that a transition shuffles what came and not what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def keep(rows: DataFrame, table: str, key: str = "url", buckets: int = 64) -> DataFrame:
    """Writes a snapshot as a table in buckets of its key, sorted within each; returns it as kept."""
    # one file a bucket: tasks are dealt by the hash that buckets go by
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)


def dealt(batch: DataFrame, buckets: int, key: str = "url") -> DataFrame:
    """A batch dealt as a snapshot's buckets are; what is grouped by or joined on the key from here on is not shuffled again."""
    return batch.repartition(buckets, key)


def replace(rows: DataFrame, table: str, key: str = "url", buckets: int = 64) -> DataFrame:
    """The next snapshot in the place of the one that it was made from, which is read to the end before it goes."""
    spark: SparkSession = rows.sparkSession
    aside = f"{table}_next"
    keep(rows, aside, key, buckets)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"ALTER TABLE {aside} RENAME TO {table}")
    return spark.table(table)

