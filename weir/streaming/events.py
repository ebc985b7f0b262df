"""Telemetry streams: events to logs, metrics and worker states; throughput."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions import telemetry
from weir.operators.numbering import checkpoint_folder, dropped
from weir.streaming import retention

EVENT = T.StructType([T.StructField(n, t) for n, t in (("type", T.StringType()), ("daemonId", T.StringType()), ("workerId", T.IntegerType()), ("payload", T.StringType()), ("ts", T.TimestampType()))])


def envelopes(events: DataFrame) -> DataFrame:
    """Events with defaults: type info, daemon local-default."""
    blank = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d)).alias(c)
    return events.select(blank("type", "info"), blank("daemonId", "local-default"), "workerId", "payload", F.col("ts").cast("timestamp").alias("ts"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON events."""
    return envelopes(spark.readStream.schema(EVENT).json(path))


def logs(events: DataFrame) -> DataFrame:
    rows = events.where(F.col("type").isin(telemetry.LOGGED_TYPES)).withColumn("__log", telemetry.logged(F.col("type"), F.col("payload")))
    return rows.select(F.col("daemonId").alias("daemon_identifier"), F.col("workerId").alias("external_worker_id"), "__log.level", "__log.message", "payload", F.col("ts").alias("created_at"))


def metrics(events: DataFrame) -> DataFrame:
    values = F.explode(telemetry.metrics(F.col("type"), F.col("payload"))).alias("metric_name", "metric_value")
    return events.select(F.col("daemonId").alias("daemon_identifier"), F.col("workerId").alias("external_worker_id"), values, "payload", F.col("ts").alias("created_at"))


def worker_updates(events: DataFrame) -> DataFrame:
    """What events say of workers: status, URL and counters; a spawned worker is idle."""
    p = lambda n: telemetry.field(F.col("payload"), n)
    status = F.coalesce(p("status"), F.when(F.col("type") == "worker-spawned", "idle"))
    return events.where("workerId is not null").select(F.col("workerId").alias("worker_id"), "ts", F.xxhash64("type", "payload").alias("id"), status.alias("status"), F.coalesce(p("currentUrl"), p("url")).alias("current_url"), p("pagesProcessed").try_cast("long").alias("pages_processed"), p("errorCount").try_cast("long").alias("error_count"))


def persist(events: DataFrame, out: str, checkpoint: str):
    """Starts a query that appends each batch's logs, metrics and worker updates to tables by day below out."""

    def write(batch: DataFrame, number: int) -> None:
        # dealt out, as payloads take long to read and a file's few row groups would be as few tasks
        batch = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism).persist()
        for name, rows, time in (("worker_log", logs(batch), "created_at"), ("worker_metric", metrics(batch), "created_at"), ("worker_update", worker_updates(batch), "ts")):
            retention.append_batch(rows, f"{out}/{name}", time, number)
        batch.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def throughput(metric_stream: DataFrame, bucket_seconds: int = 30, late: str | None = None, name: str = "page_processed") -> DataFrame:
    """Sums of a metric in buckets counted from 2001; late: how long to wait for late rows (then finished buckets can be appended)."""
    rows = metric_stream.where(F.col("metric_name") == name).withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows = rows.withWatermark("created_at", late) if late else rows
    w = F.window("created_at", f"{bucket_seconds} seconds", f"{bucket_seconds} seconds", f"{978307200 % bucket_seconds} seconds")
    return rows.groupBy(w.alias("w")).agg(F.sum("metric_value").alias("value")).select(F.col("w.start").alias("bucket"), "value")


def worker_states(updates: DataFrame) -> DataFrame:
    """Each worker's last known status, URL and counters, from a stream of updates (output mode update or complete)."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "id"))).alias(c)
    return updates.groupBy("worker_id").agg(*[last(c) for c in ("status", "current_url", "pages_processed", "error_count")], F.max("ts").alias("last_heartbeat_at"))


STORE = "spark.sql.streaming.stateStore.providerClass"


def run_to_end(stream: DataFrame, mode: str, name: str, seconds: int | None = None, store: str | None = None) -> DataFrame:
    """Drives a stream over all its input; its rows, from files in the folder that driver and executors share, which go when the program ends.

    Mode complete keeps the last batch, append all.  seconds: how long it may take, if not as long as its input needs.  store: the
    state store that the stream needs."""
    spark = stream.sparkSession
    path = f"{checkpoint_folder(spark)}/weir-{name}-{uuid.uuid4().hex}"
    atexit.register(dropped, spark, path)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes its own folder again
        batch.write.mode("overwrite").parquet(f"{path}/rows/{'all' if mode == 'complete' else f'batch-{number}'}")

    before = spark.conf.get(STORE, None)
    if store:
        spark.conf.set(STORE, store)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start()
    finally:
        if store:
            spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    try:
        if seconds is None:
            query.awaitTermination()
        elif not query.awaitTermination(seconds):
            raise TimeoutError(f"{name} has not ended after {seconds} s")
    finally:
        query.stop()
    if not retention.folders(spark, f"{path}/rows"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
