"""Intermediate tables in the folder that driver and executors share, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side is broadcast.
BROADCAST_BYTES = 48_000_000
#: Edges up to which components are found in one partition.
SMALL_EDGES = 300_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, as in tests, a folder of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else "file://" + tempfile.mkdtemp(prefix="weir-")
        spark.conf.set("spark.checkpoint.dir", path) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Saved:
    """A DataFrame written once as Parquet; later readers start from the files, not from its lineage.

    With buckets (column, number) a join by that column does not shuffle it."""

    def __init__(self, df: DataFrame, name: str, buckets: tuple[str, int] | None = None):
        self.spark = df.sparkSession
        key = uuid.uuid4().hex
        self.path = f"{shared_dir(self.spark)}/weir-{name}-{key}"
        self.table = f"weir_{name}_{key}" if buckets else None
        if buckets:
            df.write.bucketBy(buckets[1], buckets[0]).option("path", self.path).format("parquet").saveAsTable(self.table)
            self.df = self.spark.table(self.table)
        else:
            df.write.parquet(self.path)
            self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(self.drop)

    def drop(self) -> None:
        """Deletes the files; nothing may read the table afterwards."""
        atexit.unregister(self.drop)
        with contextlib.suppress(Exception):  # the session may be gone already
            if self.table:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fixed(df: DataFrame, name: str) -> DataFrame:
    """Rows that come in the same places whenever they are read: those of a plain scan of files as they are, any others from a copy.

    Only then does monotonically_increasing_id() name the same row twice."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    steps = {line.strip(" :+-").split(" ")[0] for line in plan.splitlines() if line.strip(" :+-")}
    return df if steps <= {"Project", "Filter", "Relation"} else Saved(df, name).df


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The table as a broadcast side if its rows are at most so many bytes all in all; as it is, if not."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) if t == "binary" else F.coalesce(F.size(c), F.lit(0)) * 8 if t.startswith("array") else F.lit(8) for c, t in df.dtypes]
    n = df.agg(F.sum(sum(sizes, F.lit(40)))).first()[0] or 0
    return F.broadcast(df) if n <= most else df


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of DataFrames that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame, most_rounds: int = 60) -> Saved:
    """Connected components of edges(a, b): rows (id, comp), comp the smallest id of the component, for every id that has an edge.

    Alternating star contraction: each round links every neighbour of a node to the smallest one, first
    upwards, then downwards, so that the depth of each tree shrinks geometrically; the edge table never grows.
    """
    now = Saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    # a small table is contracted in one partition, which needs no exchange
    few = now.df.count() <= SMALL_EDGES
    mark = None
    for _ in range(most_rounds):
        edges = now.df.coalesce(1) if few else now.df
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.coalesce(1) if few else both
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        new = Saved(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        now.drop()
        now = new
        found = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError("components did not settle")
    roots = now.df.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("comp"))
    out = Saved(now.df.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(roots), "components")
    now.drop()
    return out
