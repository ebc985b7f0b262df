"""Whether workers claim the seeds they were assigned, as it happens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Groups of workers in each span of time.
BUCKETS = 16
TOLD = "seed_url string, worker string, assigned long, claimed_url string"
HELD = ["worker", "micros", "url", "claim"]


def outcome(seed, claimed):
    """completed: the seed itself was claimed, in whatever case; conflict: another URL; pending: nothing yet."""
    return F.when(claimed.isNull(), "pending").when(F.lower(claimed) == F.lower(seed), "completed").otherwise("conflict")


def first_claims(assigned: pd.DataFrame, claims: pd.DataFrame, wait: int) -> pd.DataFrame:
    """Each assignment, once, with its worker's first claim at its time or up to ``wait`` after it."""
    a = assigned.drop_duplicates(["worker", "micros", "url"]).sort_values("micros", kind="stable").rename(columns={"url": "seed_url"})
    c = claims.sort_values(["micros", "url"]).drop_duplicates(["worker", "micros"])[["worker", "micros", "url"]]
    if len(c) and len(a):
        # workers by number: names are slow to compare; no worker's assignments meet no claim
        names = pd.concat([a["worker"], c["worker"]])
        codes = pd.factorize(names)[0]
        a, c = a.assign(code=codes[: len(a)]), c.assign(code=codes[len(a) :])
        a = pd.merge_asof(a, c[["code", "micros", "url"]], on="micros", by="code", direction="forward", tolerance=wait)
    else:
        a = a.assign(url=None)
    return pd.DataFrame({"seed_url": a["seed_url"], "worker": a["worker"], "assigned": a["micros"], "claimed_url": a["url"].astype(object).where(a["url"].notna(), None)})


def packed(rows: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows[HELD], schema=pa.schema([("worker", pa.string()), ("micros", pa.int64()), ("url", pa.string()), ("claim", pa.bool_())]), preserve_index=False)
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


def _as_it_happens(wait: int):
    """Keeps the rows of a span's workers, and tells the assignments whose wait both streams' time has passed."""

    def told(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        new = [] if state.hasTimedOut else [f[HELD] for f in frames]
        rows = pd.concat(([unpacked(bytes(state.get[0]))] if state.exists else []) + new, ignore_index=True)
        now = max(0, state.getCurrentWatermarkMs())
        claim = rows["claim"].astype(bool)
        over = ~claim & (rows["micros"] + wait < now * 1000)
        out = first_claims(rows[over], rows[claim], wait)
        left = rows[~over]
        waiting, end = left.loc[~left["claim"].astype(bool), "micros"], (int(key[0]) + 1) * wait // 1000
        if len(waiting) or now <= end:
            state.update((packed(left),))
            state.setTimeoutTimestamp(max(now + 1, (int(waiting.min()) + wait) // 1000 if len(waiting) else end))
        else:
            state.remove()
        yield out

    return told


def _at_once(wait: int):
    def told(rows: pd.DataFrame) -> pd.DataFrame:
        claim = rows["claim"].astype(bool)
        return first_claims(rows[~claim], rows[claim], wait)

    return told


def arbitrated(assigned: DataFrame, claims: DataFrame, wait: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """The outcome of each of a stream's assignments (seed_url, worker_id, assigned_at): seed_url, worker_id, assigned_at, claimed_url, outcome.

    What counts is the worker's first claim in a stream of claims (worker_id, url, claimed_at) at the time of the assignment or up to
    ``wait`` after it; of claims at one time the smallest URL.  Both streams have watermarks ``late`` behind their latest rows.  Once both have
    passed the end of an assignment's wait, its outcome is told: pending if no claim has come.  Repeated assignments are one.

    Rows meet in groups of workers by spans of time as long as the wait, an assignment in its own and a claim in its own and the one before.
    Within a group both are sorted, so that the work grows with the rows: a join would compare all assignments of a busy worker with all its
    claims of their spans.  Rows behind the watermark are left out."""
    spark = assigned.sparkSession
    length = spark.range(1).select(F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {wait})")).first()[0]
    a = assigned.select("worker_id", F.col("assigned_at").alias("at"), F.col("seed_url").alias("url")).where("at IS NOT NULL").withWatermark("at", late)
    a = a.withColumn("waits", F.expr(f"unix_micros(at) div {length}")).withColumn("claim", F.lit(False))
    c = claims.select("worker_id", F.col("claimed_at").alias("at"), "url").where("worker_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    c = c.withColumn("waits", F.explode(F.expr(f"array(unix_micros(at) div {length} - 1, unix_micros(at) div {length})"))).withColumn("claim", F.lit(True))
    worker = F.col("worker_id").cast("string")
    rows = a.unionByName(c).select("waits", F.pmod(F.xxhash64("worker_id"), F.lit(BUCKETS)).alias("bucket"), worker.alias("worker"), "at", F.unix_micros("at").alias("micros"), "url", "claim")
    groups = rows.groupBy("waits", "bucket")
    if rows.isStreaming:
        out = groups.applyInPandasWithState(_as_it_happens(length), TOLD, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    else:
        out = groups.applyInPandas(_at_once(length), TOLD)
    at = F.timestamp_micros("assigned").alias("assigned_at")
    return out.select("seed_url", F.col("worker").cast(assigned.schema["worker_id"].dataType).alias("worker_id"), at, "claimed_url", outcome(F.col("seed_url"), F.col("claimed_url")).alias("outcome"))
