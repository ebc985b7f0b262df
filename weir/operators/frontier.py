"""The crawl frontier as a table: every transition is a function from a snapshot to the next one.

A snapshot has id, url, priority, source_url, depth, state, discovered_at, dequeued_at, finished_at, locked_at,
locked_by_worker_id; ``now`` is always given, so results don't depend on the clock.  One transition is one join
on the URL or the id, so its cost follows the snapshot and not the number of requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.functions import telemetry
from weir.functions.url import site_key
from weir.operators.numbering import numbered

TTL_SECONDS, TOMBSTONE_SECONDS, WINDOW = 30, 600, 64


def _seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def status(frontier: DataFrame) -> DataFrame:
    """One row of counts: known, queued, locked, processing, completed, duplicate, failed, cached, leases, tombstones."""
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    return frontier.agg(
        F.count(F.lit(1)).alias("known_urls"), n("QUEUED").alias("queued"), n("LOCKED").alias("locked"), n("PROCESSING").alias("processing"), n("COMPLETED").alias("completed"),
        n("DUPLICATE").alias("duplicate"), n("FAILED").alias("failed"), F.count_if("memory_cached").alias("memory_cached"), n("LOCKED", "PROCESSING").alias("active_leases"), n("COMPLETED", "DUPLICATE", "FAILED").alias("tombstones"),
    )


def by_state(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def top_queued(frontier: DataFrame, take: int = 20) -> DataFrame:
    """The next URLs: by priority, then discovery, then id; 1 to 100 of them."""
    return frontier.where("state = 'QUEUED'").orderBy(F.desc("priority"), "discovered_at", "id").limit(min(max(take, 1), 100))


def top_locked(frontier: DataFrame, take: int = 10) -> DataFrame:
    """Leased URLs, latest first; 1 to 50 of them."""
    return frontier.where(F.col("state").isin("LOCKED", "PROCESSING")).orderBy(F.desc_nulls_last("locked_at"), F.desc("priority"), "discovered_at", "id").limit(min(max(take, 1), 50))


def locked_total(frontier: DataFrame) -> DataFrame:
    return frontier.agg(F.count_if(F.col("state").isin("LOCKED", "PROCESSING")).alias("n"))


def expired(now: Column, ttl_seconds: int = TTL_SECONDS) -> Column:
    """Whether a lease is older than its time to live (5 to 3600 seconds); work in progress never expires."""
    ttl = min(max(ttl_seconds, 5), 3600)
    return (F.col("state") == "LOCKED") & (F.col("locked_at") < now - F.expr(f"INTERVAL {ttl} SECONDS"))


def requeue_expired(frontier: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    gone = F.coalesce(expired(now, ttl_seconds), F.lit(False))
    clear = lambda c: F.when(~gone, F.col(c)).alias(c)
    own = {"state": F.when(gone, "QUEUED").otherwise(F.col("state")).alias("state"), "locked_at": clear("locked_at"), "locked_by_worker_id": clear("locked_by_worker_id")}
    return frontier.select(*[own.get(c, F.col(c)) for c in frontier.columns])


def merge_batch(candidates: DataFrame) -> DataFrame:
    """Candidates (url, priority, depth, source_url, discovered_at, ord) by URL: the greatest priority, the least depth, the first source."""
    return candidates.where("url is not null and trim(url) <> ''").groupBy("url").agg(
        F.max("priority").alias("priority"), F.min(F.greatest("depth", F.lit(0))).alias("depth"),
        F.min_by("source_url", F.when(F.col("source_url").isNotNull(), F.col("ord"))).alias("source_url"), F.min("discovered_at").alias("discovered_at"),
    )


def enqueue(frontier: DataFrame, batch: DataFrame, keep_terminal: bool = False) -> DataFrame:
    """The snapshot after merge_batch()'s rows have come in.

    A known URL keeps the greater priority, the first source, the lesser depth and the earlier discovery.  Online, a
    completed or failed one is queued again and its marks are cleared, others keep their state; offline
    (keep_terminal), completed, failed and duplicate ones stay as they are and all others are queued."""
    new = batch.select("url", *[F.col(c).alias(f"n_{c}") for c in ("priority", "depth", "source_url", "discovered_at")])
    both = frontier.join(new, "url", "full_outer")
    known, came = F.col("state").isNotNull(), F.col("n_priority").isNotNull()
    terminal = F.col("state").isin("COMPLETED", "FAILED")
    again = (came & ~known) | (came & known & (terminal if not keep_terminal else ~F.col("state").isin("COMPLETED", "FAILED", "DUPLICATE")))
    revived = came & terminal & (not keep_terminal)
    last = frontier.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long"))
    own = {
        "priority": F.greatest("priority", "n_priority"), "depth": F.least("depth", "n_depth"), "source_url": F.coalesce("source_url", "n_source_url"), "discovered_at": F.least("discovered_at", "n_discovered_at"),
        "state": F.when(F.coalesce(again, F.lit(False)), "QUEUED").otherwise(F.col("state")),
    }
    cleared = [c for c in ("dequeued_at", "finished_at", "locked_at", "locked_by_worker_id") if c in frontier.columns]
    own |= {c: F.when(~F.coalesce(revived, F.lit(False)), F.col(c)) for c in cleared}
    old = both.where("id is not null").select(*[own.get(c, F.col(c)).alias(c) for c in frontier.columns])
    # ids of new rows, and of those alone, follow the greatest one, in the order of their URLs
    added = numbered(both.where("id is null").drop("id"), "id", ["url"], last).withColumn("id", F.col("id").cast(dict(frontier.dtypes)["id"]))
    return old.unionByName(added.select(*[own.get(c, F.col(c)).alias(c) for c in frontier.columns]))


def _order() -> list[Column]:
    return [F.desc("priority"), F.col("discovered_at"), F.col("id")]


def heads(frontier: DataFrame, ready: DataFrame | None, now: Column, window: int | None = None) -> DataFrame:
    """The best queued URL of each site whose cooldown has passed.  ready: (site_key, ready_at); window: how many of the best queued URLs are looked at (None: all)."""
    queued = frontier.where("state = 'QUEUED'").withColumn("site_key", site_key(F.col("url")))
    if window:
        queued = queued.orderBy(F.desc("priority"), "discovered_at", "id").limit(window)
    best = queued.groupBy("site_key").agg(F.min_by(F.struct("id", "url", "priority", "discovered_at"), F.struct(-F.col("priority"), "discovered_at", "id")).alias("h")).select("site_key", "h.*")
    if ready is not None:
        best = best.join(ready.where(F.col("ready_at") > now).select("site_key").distinct(), "site_key", "left_anti")
    return best


def ranked_heads(frontier: DataFrame, ready: DataFrame | None, now: Column, window: int | None = None) -> DataFrame:
    """heads() with their rank among all sites."""
    return numbered(heads(frontier, ready, now, window), "rank", _order())


def dequeue(frontier: DataFrame, worker_ids: list[int], limit: int, now: Column, ready: DataFrame | None = None, window: int | None = None) -> DataFrame:
    """Claims (worker_id, id, url, site_key, priority): the k-th ready site for the k-th distinct positive worker, 1 to 100 of them."""
    workers = list(dict.fromkeys(w for w in worker_ids if w > 0))[: min(max(limit, 1), 100)]
    asked = frontier.sparkSession.createDataFrame([(k + 1, w) for k, w in enumerate(workers)], "rank int, worker_id int")
    # only as many heads as there are workers are ranked
    best = heads(frontier, ready, now, window).orderBy(*_order()).limit(max(1, len(workers)))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*_order()))).join(F.broadcast(asked), "rank").select("worker_id", "id", "url", "site_key", "priority")


def claim(frontier: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """The snapshot after dequeue()'s claims."""
    won = claims.select("id", F.col("worker_id").alias("__worker"))
    both = frontier.join(won, "id", "left")
    has = F.col("__worker").isNotNull()
    own = {"state": F.when(has, "LOCKED").otherwise(F.col("state")), "locked_at": F.when(has, now).otherwise(F.col("locked_at")), "locked_by_worker_id": F.coalesce("__worker", "locked_by_worker_id"), "dequeued_at": F.when(has, now).otherwise(F.col("dequeued_at")) if "dequeued_at" in frontier.columns else None}
    return both.select(*[own.get(c, F.col(c)).alias(c) for c in frontier.columns])


def complete(frontier: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The snapshot after results (token, url, worker_id, status): a lease ends only if its id, URL and worker are right."""
    asked = results.select(F.col("token").alias("id"), F.col("url").alias("__url"), F.col("worker_id").alias("__worker"), telemetry.terminal_state(F.col("status")).alias("__state"))
    # of several results for a lease the one that is right counts, then the first state by name
    held = frontier.select("id", F.col("url").alias("__u"), F.col("locked_by_worker_id").alias("__w"))
    right = (F.col("__url") == F.col("__u")) & (F.col("__worker") == F.col("__w"))
    asked = asked.join(held, "id").where(right).groupBy("id").agg(F.min(F.struct("__state", "__url", "__worker")).alias("r")).select("id", "r.*")
    both = frontier.join(asked, "id", "left")
    ok = F.coalesce((F.col("url") == F.col("__url")) & (F.col("locked_by_worker_id") == F.col("__worker")) & F.col("state").isin("LOCKED", "PROCESSING"), F.lit(False))
    again = F.col("__state") == "QUEUED"
    clear = lambda c: F.when(~ok, F.col(c))
    own = {"state": F.when(ok, F.col("__state")).otherwise(F.col("state")), "locked_at": clear("locked_at"), "locked_by_worker_id": clear("locked_by_worker_id"), "finished_at": F.when(ok & again, None).when(ok, now).otherwise(F.col("finished_at")) if "finished_at" in frontier.columns else None, "dequeued_at": F.when(ok & again, None).otherwise(F.col("dequeued_at")) if "dequeued_at" in frontier.columns else None}
    return both.select(*[own.get(c, F.col(c)).alias(c) for c in frontier.columns])


def prune(frontier: DataFrame, requests: DataFrame) -> DataFrame:
    """The snapshot after requests (url, worker_id): a queued URL, or one leased by the same worker, has failed."""
    asked = requests.select("url", F.col("worker_id").alias("__worker")).dropDuplicates(["url", "__worker"]).groupBy("url").agg(F.collect_set("__worker").alias("__workers"))
    both = frontier.join(asked, "url", "left")
    hit = F.coalesce(F.col("__workers").isNotNull() & ((F.col("state") == "QUEUED") | ((F.col("state") == "LOCKED") & F.array_contains("__workers", F.col("locked_by_worker_id")))), F.lit(False))
    return both.select(*[F.when(hit, "FAILED").otherwise(F.col("state")).alias("state") if c == "state" else F.col(c) for c in frontier.columns])


def cleanup(frontier: DataFrame, states: list[str]) -> DataFrame:
    """Without the rows in the given states, in whatever case."""
    return frontier.where(~F.lower("state").isin([s.lower() for s in states]))


def cooldowns(registry: DataFrame, observed: DataFrame, now: Column) -> DataFrame:
    """Registry (crawler, site_key, ready_at) after observed (crawler, site_key, delay_ms): the later time wins, those past are dropped."""
    came = observed.select("crawler", "site_key", (now + F.make_dt_interval(secs=F.greatest(F.lit(5000), F.col("delay_ms")) / 1000)).alias("ready_at"))
    return registry.unionByName(came).groupBy("crawler", "site_key").agg(F.max("ready_at").alias("ready_at")).where(F.col("ready_at") > now)


def cooldown_snapshot(registry: DataFrame, hosts: DataFrame, now: Column, take: int = 128) -> DataFrame:
    """Active cooldowns with seconds left and up to six hosts of hosts(site_key, host); most left first, 1 to 128."""
    names = hosts.groupBy("site_key").agg(F.slice(F.array_sort(F.collect_set(F.lower("host"))), 1, 6).alias("hosts"))
    left = _seconds_between(now, F.col("ready_at"))
    return registry.withColumn("remaining", left).where("remaining > 0").join(names, "site_key", "left").orderBy(F.desc("remaining"), "site_key").limit(min(max(take, 1), 128))


def violations(requests: DataFrame, minimum_seconds: float) -> DataFrame:
    """Requests (ip, ts) that came too soon after the one before."""
    before = F.lag("ts").over(Window.partitionBy("ip").orderBy("ts"))
    return requests.withColumn("gap", _seconds_between(before, F.col("ts"))).where(F.col("gap") < minimum_seconds)


def allowed_hosts(rows: DataFrame, hosts: list[str], host_col: str = "host") -> DataFrame:
    """Rows whose host is one of hosts or below one; no hosts allow all."""
    from weir.functions.url import host_in

    return rows.where(host_in(F.col(host_col), hosts)) if hosts else rows


def seed_priorities(seeds: DataFrame) -> DataFrame:
    """Seeds (url, ord), each once, with priority 100 less its place, 10 at least."""
    first = seeds.groupBy("url").agg(F.min("ord").alias("ord"))
    # from the 91st place on, all have the least priority
    best = first.orderBy("ord", "url").limit(100).withColumn("priority", F.greatest(F.lit(10), F.lit(101) - F.row_number().over(Window.orderBy("ord", "url"))))
    return first.join(F.broadcast(best.select("url", "priority")), "url", "left").select("url", "ord", F.coalesce("priority", F.lit(10)).alias("priority"))


def active_timeouts(registry: DataFrame, now: Column, take: int = 12) -> DataFrame:
    """The longest cooldowns left of registry(site_key, ready_at), keys without case breaking ties."""
    left = _seconds_between(now, F.col("ready_at"))
    return registry.withColumn("remaining", left).where("remaining > 0").orderBy(F.desc("remaining"), F.lower("site_key"), "site_key").limit(take)
