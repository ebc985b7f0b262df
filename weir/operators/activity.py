"""Throughput, logs, commands, workers and seed assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.functions import hashing, telemetry
from weir.operators.numbering import numbered

ORIGIN_2001 = 978307200


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the bucket that ts lies in, counted from 2001-01-01."""
    s = F.unix_seconds(ts) - ORIGIN_2001
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds)) + ORIGIN_2001)


def throughput(metrics: DataFrame, now: Column, window_minutes: int = 60, bucket_seconds: int = 30, by: list[str] | None = None, name: str = "page_processed") -> DataFrame:
    """Sums of a metric (metric_name, metric_value, created_at) in buckets of 10 to 600 seconds over the last 5 to 1440 minutes."""
    minutes, seconds = min(max(window_minutes, 5), 1440), min(max(bucket_seconds, 10), 600)
    ts = F.col("created_at").cast("timestamp")
    rows = metrics.where((F.col("metric_name") == name) & (ts >= now - F.expr(f"INTERVAL {minutes} MINUTES")) & (ts <= now))
    return rows.groupBy(*(by or []), bucket(ts, seconds).alias("bucket")).agg(F.round(F.sum("metric_value"), 6).alias("value"))


def live_throughput(events: DataFrame, bucket_seconds: int) -> DataFrame:
    """The same from events (payload, ts): what their payloads say was processed, where it is more than nothing."""
    rows = events.withColumn("inc", telemetry.metric_increment(F.col("payload"))).where("inc > 0")
    return rows.groupBy(bucket(F.col("ts").cast("timestamp"), bucket_seconds).alias("bucket")).agg(F.sum("inc").alias("value"))


def metric_rows(events: DataFrame) -> DataFrame:
    """A row (id, metric_name, metric_value) for each number of events (id, type, payload)."""
    return events.select("id", F.explode(telemetry.metrics(F.col("type"), F.col("payload"))).alias("metric_name", "metric_value"))


def search_logs(logs: DataFrame, worker: int | None = None, severity: str | None = None, term: str | None = None, limit: int = 120) -> DataFrame:
    """Logs, newest first; 1 to 400 of them."""
    rows = logs if worker is None else logs.where(F.col("external_worker_id") == worker)
    rows = rows.where(F.lower("level") == severity.strip().lower()) if (severity or "").strip() else rows
    rows = rows.where(F.col("message").ilike(f"%{term.strip()}%")) if (term or "").strip() else rows
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(min(max(limit, 1), 400))


def level_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def attention_count(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count_if(F.lower("level").isin("warning", "error")).alias("n"))


def retained(rows: DataFrame, now: Column, days: int) -> DataFrame:
    """Rows not older than so many days."""
    return rows.where(F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def gauges(metrics: DataFrame, key: list[str]) -> DataFrame:
    """The last value of each metric, by time and then id."""
    return metrics.groupBy(*key, "metric_name").agg(F.max_by("metric_value", F.struct("created_at", "id")).alias("value"))


def transitions(events: DataFrame, key: str, state: str) -> DataFrame:
    """Events at which a key's state differs from the one before, with both."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy("ts", "id"))
    return events.withColumn("previous", before).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(state))).select("id", key, "ts", "previous", state)


def illegal_transitions(events: DataFrame, key: str, state: str) -> DataFrame:
    """Of those the ones that a worker's states don't allow."""
    legal = events.sparkSession.createDataFrame(telemetry.TRANSITIONS, "previous string, now string")
    rows = transitions(events.withColumn(state, F.upper(state)), key, state)
    return rows.join(F.broadcast(legal), (rows["previous"] == legal["previous"]) & (rows[state] == legal["now"]), "left_anti")


def ordered_events(events: DataFrame, types: list[str]) -> DataFrame:
    """Events of the types with their place in order of time."""
    return numbered(events.where(F.col("type").isin(types)), "ord", ["ts", "id"])


def recent_events(events: DataFrame, limit: int = 80) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("id")).limit(min(max(limit, 1), 5000))


def arbitration_events(events: DataFrame, limit: int = 20) -> DataFrame:
    low = F.lower("type")
    return events.where(low.startswith("frontier") | (low == "queue-change")).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def command_diagnostics(commands: DataFrame, now: Column, hours: int) -> DataFrame:
    """One row of counts by status in the last hours; failed starts of a daemon don't count."""
    rows = commands.where((F.col("created_at") >= now - F.expr(f"INTERVAL {hours} HOURS")) & ~((F.col("status") == "failed") & (F.col("command_type") == "start-daemon")))
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "dispatched", "acknowledged", "completed", "failed")])


def last_failure(commands: DataFrame) -> DataFrame:
    """The newest error message of a failed command that is no start of a daemon."""
    rows = commands.where("status = 'failed' and command_type <> 'start-daemon' and error_message is not null")
    return rows.agg(F.max_by(F.struct("id", "error_message"), F.struct("created_at", "id")).alias("f")).select("f.id", "f.error_message")


def oldest(commands: DataFrame, statuses: list[str], limit: int = 100) -> DataFrame:
    return commands.where(F.col("status").isin(statuses)).orderBy("created_at", "id").limit(limit)


def stale_commands(commands: DataFrame, now: Column, seconds: int = 45, limit: int = 100) -> DataFrame:
    """Commands dispatched or acknowledged, not completed, and sent longer ago than that; the oldest so many, which one round takes."""
    stale = F.col("status").isin("dispatched", "acknowledged") & F.col("completed_at").isNull() & (F.col("dispatched_at") < now - F.expr(f"INTERVAL {seconds} SECONDS"))
    return commands.where(stale).orderBy("dispatched_at", "id").limit(limit)


def recover_stale(commands: DataFrame, now: Column, seconds: int = 45, limit: int = 100) -> DataFrame:
    """Commands after the stale ones have been queued again, with the reason as their error."""
    found = stale_commands(commands, now, seconds, limit).select("id", F.lit(True).alias("__stale"))
    stale = F.coalesce("__stale", F.lit(False))
    reason = F.format_string(f"Requeued stale in-flight command (%s) after {seconds}s timeout.", F.col("status"))
    own = {"status": F.when(stale, "queued").otherwise(F.col("status")), "dispatched_at": F.when(~stale, F.col("dispatched_at")), "error_message": F.when(stale, reason).otherwise(F.col("error_message"))}
    return commands.join(F.broadcast(found), "id", "left").select(*[own.get(c, F.col(c)).alias(c) for c in commands.columns])


def stale_logs(commands: DataFrame, daemons: DataFrame, now: Column, seconds: int = 45, limit: int = 100) -> DataFrame:
    """The warnings (daemon, level, message) that go with recover_stale()."""
    rows = with_daemon(stale_commands(commands, now, seconds, limit), daemons)
    message = F.format_string("[command-dispatch] commandId=%d type=%s status=queued reason=in-flight-timeout", F.col("id"), F.col("command_type"))
    return rows.select("id", "daemon", F.lit("Warning").alias("level"), message.alias("message"))


def dispatch(commands: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Commands after the oldest queued ones have been sent out."""
    sent = oldest(commands, ["queued"], limit).select("id", F.lit(True).alias("__sent"))
    has = F.coalesce("__sent", F.lit(False))
    own = {"status": F.when(has, "dispatched").otherwise(F.col("status")), "dispatched_at": F.when(has, now).otherwise(F.col("dispatched_at"))}
    return commands.join(F.broadcast(sent), "id", "left").select(*[own.get(c, F.col(c)).alias(c) for c in commands.columns])


def answered(commands: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """Commands after workers' answers (id, kind: ack or result, ok, error), of which a result counts more than an acknowledgement.

    An acknowledged command gets its time; a result completes or fails it; its error is that of the answer, none if it has none."""
    last = answers.groupBy("id").agg(F.max(F.struct((F.col("kind") == "result").alias("done"), F.col("ok").alias("ok"), F.col("error").alias("error"))).alias("__a"))
    both = commands.join(last, "id", "left")
    has = F.col("__a").isNotNull()
    done = F.col("__a.done")
    status = F.when(done & F.col("__a.ok"), "completed").when(done, "failed").otherwise("acknowledged")
    own = {"status": F.when(has, status).otherwise(F.col("status")), "error_message": F.when(has, F.col("__a.error")).otherwise(F.col("error_message")), "acknowledged_at": F.when(has & ~done, now).otherwise(F.col("acknowledged_at")), "completed_at": F.when(has & done, now).otherwise(F.col("completed_at"))}
    return both.select(*[own.get(c, F.col(c)).alias(c) for c in commands.columns])


def with_daemon(commands: DataFrame, daemons: DataFrame) -> DataFrame:
    """Commands with their daemon's own name, ``local-default`` where its metadata has none."""
    named = daemons.select(F.col("id").alias("daemon_id"), F.coalesce(F.get_json_object("metadata", "$.daemonId"), F.lit("local-default")).alias("daemon"))
    return commands.join(named, "daemon_id")


def resolve_daemon(asked: DataFrame, daemons: DataFrame) -> DataFrame:
    """For asked(identifier) the daemon whose metadata has it, else the one of that name."""
    names = daemons.select("id", F.explode(F.array(F.struct(F.lit(0).alias("r"), F.get_json_object("metadata", "$.daemonId").alias("k")), F.struct(F.lit(1).alias("r"), F.lower("name").alias("k")))).alias("e")).select("id", "e.*")
    keys = asked.select("identifier", F.explode(F.array(F.struct(F.lit(0).alias("r"), F.col("identifier").alias("k")), F.struct(F.lit(1).alias("r"), F.lower("identifier").alias("k")))).alias("e")).select("identifier", "e.*")
    return keys.join(names, ["r", "k"]).groupBy("identifier").agg(F.min_by("id", F.struct("r", "id")).alias("daemon_id"))


def status_counts(workers: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Workers by capitalised status; given statuses, exactly those, with 0 where there is none."""
    counts = workers.groupBy(telemetry.capitalised(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    if not statuses:
        return counts
    every = workers.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return F.broadcast(every).join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def filtered_workers(workers: DataFrame, status: str = "ALL", term: str | None = None) -> DataFrame:
    """Workers (name, status, current_url) of a status, whatever its case, whose name or URL has the term; by name."""
    rows = workers if status == "ALL" else workers.where(F.lower("status") == status.lower())
    t = (term or "").strip().lower()
    rows = rows.where(F.contains(F.lower("name"), F.lit(t)) | F.coalesce(F.contains(F.lower("current_url"), F.lit(t)), F.lit(False))) if t else rows
    return rows.orderBy("name")


def daemon_statistics(workers: DataFrame) -> DataFrame:
    return workers.agg(F.count(F.lit(1)).alias("workers"), F.count_if(F.lower("status") == "active").alias("active"), F.sum("pages_processed").alias("pages_processed"), F.sum("error_count").alias("errors"))


def active_workers(workers: DataFrame, daemons: DataFrame, nodes: DataFrame) -> DataFrame:
    """Active workers of daemons that are up, with the node of their current URL."""
    up = daemons.where(~F.lower(F.coalesce("status", F.lit(""))).isin("offline", "stopped", "")).select(F.col("id").alias("daemon_id"))
    rows = workers.where(F.lower(F.coalesce("status", F.lit(""))) == "active").join(up, "daemon_id")
    first = nodes.groupBy(F.col("url").alias("current_url")).agg(F.min("id").alias("node_id"))
    return rows.join(first, "current_url", "left")


def shares(values: DataFrame, label: str, value: str) -> DataFrame:
    """Slices of a pie: start and sweep in degrees, greatest first; nothing for values not above 0."""
    rows = values.where(F.col(value) > 0)
    total = rows.agg(F.sum(value).alias("__t"))
    order = Window.orderBy(F.desc(value), label)
    sweep = 360.0 * F.col(value) / F.col("__t")
    return rows.crossJoin(F.broadcast(total)).select(label, value, F.round(F.coalesce(F.sum(sweep).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), 6).alias("start"), F.round(sweep, 6).alias("sweep"))


def latest_state(events: DataFrame) -> DataFrame:
    """Workers after their events (worker_id, ts, id, status, current_url, pages_processed, error_count): the last value of each that is not null or blank."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct("ts", "id"))).alias(c)
    return events.groupBy("worker_id").agg(*[last(c) for c in ("status", "current_url", "pages_processed", "error_count")], F.max("ts").alias("last_heartbeat_at"))


def latest_snapshot(snapshots: DataFrame, key: str) -> DataFrame:
    """The newest row of each key; of rows as new the greatest one, column by column."""
    cols = [c for c in snapshots.columns if c != key]
    return snapshots.groupBy(key).agg(F.max(F.struct("ts", *[c for c in cols if c != "ts"])).alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in cols])


def ungrouped(workers: DataFrame, groups: DataFrame) -> DataFrame:
    """Workers (daemon_id, worker_id) that no group (worker_keys of daemon:worker) has, by daemon."""
    taken = groups.select(F.explode("worker_keys").alias("key")).distinct()
    rows = workers.withColumn("key", F.concat_ws(":", "daemon_id", "worker_id")).join(taken, "key", "left_anti")
    return rows.groupBy("daemon_id").agg(F.array_sort(F.collect_set("worker_id")).alias("worker_ids"))


def group_of(workers: DataFrame, groups: DataFrame) -> DataFrame:
    """Each worker's first group (ord, name, worker_ids)."""
    first = groups.select(F.explode("worker_ids").alias("worker_id"), "ord", "name").groupBy("worker_id").agg(F.min_by("name", "ord").alias("group_name"))
    return workers.join(first, "worker_id", "left")


def group_delay(groups: DataFrame) -> DataFrame:
    """Seconds between requests that the strictest enabled group (worker_ids, enabled, per_minute) grants a worker."""
    rows = groups.where("enabled and per_minute > 0").select(F.explode("worker_ids").alias("worker_id"), "per_minute")
    return rows.groupBy("worker_id").agg((60.0 / F.min("per_minute")).alias("delay"))


def assigned_workers(groups: DataFrame) -> DataFrame:
    return groups.select(F.explode("worker_ids").alias("w")).agg(F.count_distinct("w").alias("n"))


def group_sizes(groups: DataFrame, workers: DataFrame) -> DataFrame:
    """How many of the workers each group has."""
    rows = groups.select("name", F.explode(F.array_distinct("worker_ids")).alias("worker_id")).join(workers.select("worker_id").distinct(), "worker_id")
    return groups.select("name").distinct().join(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def queue_timeouts(queue: DataFrame, timeouts: DataFrame) -> DataFrame:
    """Queue rows (id, host) with the cooldown (ip_key, domains, remaining) of their host, by its key first."""
    keys = timeouts.select("ip_key", "remaining", F.posexplode(F.concat(F.array("ip_key"), "domains")).alias("p", "k")).groupBy(F.lower("k").alias("host")).agg(F.min_by(F.struct("ip_key", "remaining"), F.struct("p", "ip_key")).alias("t"))
    return queue.join(keys, "host", "left").select(*queue.columns, "t.ip_key", "t.remaining")


def assign_seeds(seeds: DataFrame, workers: DataFrame, mode: str = "rendezvous", pages_weight: float = 1.0, errors_weight: float = 1.0) -> DataFrame:
    """Each seed's worker: the best score, on a tie the smallest id.

    By weight every seed has the same best worker, and round robin names one slot, so neither compares seeds with
    workers; only rendezvous hashing scores every seed against every worker, of whom there are 10,000 at most, and
    does so within a batch of seeds."""
    if mode == "weighted":
        best = workers.agg(F.max_by("worker_id", F.struct(pages_weight * F.col("pages_processed") - errors_weight * F.col("error_count"), -F.col("worker_id"))).alias("worker_id"))
        return seeds.select("url").crossJoin(F.broadcast(best))
    listed = workers.select("worker_id").distinct().withColumn("slot", F.row_number().over(Window.orderBy("worker_id")).cast("long") - 1)
    if mode == "round_robin":
        n = listed.agg(F.count(F.lit(1)).alias("n"))
        rows = seeds.select("url").crossJoin(F.broadcast(n)).withColumn("slot", hashing.stable_slot(F.col("url"), F.col("n")))
        return rows.join(F.broadcast(listed), "slot").select("url", "worker_id")
    ids = [r["worker_id"] for r in workers.select("worker_id").distinct().limit(10_001).collect()]
    if len(ids) > 10_000:
        raise ValueError("too many workers to score every seed against")
    each = seeds.select("url").distinct()
    return each.withColumn("worker_id", hashing.best_worker(F.col("url"), ids)) if ids else each.withColumn("worker_id", F.lit(None).cast("long")).limit(0)


def arbitration(assigned: DataFrame, claims: DataFrame) -> DataFrame:
    """Outcome of each assigned seed: completed if its worker claimed it, conflict if another did, else pending."""
    c = claims.groupBy("url").agg(F.min("worker_id").alias("by"))
    return assigned.join(c, "url", "left").select("url", "worker_id", F.when(F.col("by") == F.col("worker_id"), "completed").when(F.col("by").isNotNull(), "conflict").otherwise("pending").alias("outcome"))


def series_extents(series: DataFrame) -> DataFrame:
    return series.agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.greatest(F.lit(1.0), F.max("value")).alias("most"), F.bround(F.avg("value"), 2).alias("mean"), F.sum("value").alias("total"))
