"""What a crawl worker does with its own queue: taking in URLs, claiming, tombstones, the buffer of events, the preferential frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.functions import scoring
from weir.functions.url import site_key
from weir.operators.frontier import TOMBSTONE_SECONDS
from weir.operators.numbering import checkpointed, numbered

BUFFERED_EVENTS = 1000
IN_MEMORY, SWAP_BATCH = 50_000, 5000
ACTIVE = ("QUEUED", "LOCKED", "PROCESSING")


def tombstones(done: DataFrame, now: Column, seconds: int = TOMBSTONE_SECONDS) -> DataFrame:
    """URLs of done(url, finished_at) that came to an end so recently (30 seconds ago or less always counts) that they are not taken in again."""
    return done.where(F.col("finished_at") > now - F.expr(f"INTERVAL {max(seconds, 30)} SECONDS")).select("url").distinct()


def enqueue_verdicts(candidates: DataFrame, frontier: DataFrame, tombs: DataFrame, policy: scoring.Policy, prevent_collisions: bool = True) -> DataFrame:
    """What becomes of candidates (url, source_url, depth, priority, robots_allowed, ord): verdict is tombstoned, robots-disallow, already-active or queued.

    A candidate without a priority of its own gets its score's.  Of several candidates with one URL the first by ord is judged, the others
    meet it in the queue."""
    score = scoring.crawler_priority(scoring.crawler_score(F.col("url"), F.col("source_url"), F.col("depth"), policy))
    rows = candidates.withColumn("priority", F.coalesce("priority", score))
    rows = rows.join(tombs.select("url", F.lit(True).alias("__tomb")).distinct(), "url", "left")
    rows = rows.join(frontier.where(F.col("state").isin(*ACTIVE)).select("url", F.lit(True).alias("__active")).distinct(), "url", "left")
    first = F.min(F.when(F.col("__tomb").isNull() & F.coalesce("robots_allowed", F.lit(True)), F.col("ord"))).over(Window.partitionBy("url"))
    taken = F.col("__active").isNotNull() | (F.col("ord") > first)
    verdict = F.when(F.col("__tomb").isNotNull(), "tombstoned").when(~F.coalesce("robots_allowed", F.lit(True)), "robots-disallow").when(F.coalesce(taken, F.lit(False)) & F.lit(prevent_collisions), "already-active").otherwise("queued")
    return rows.withColumn("verdict", verdict).select(*candidates.columns, "verdict")


def local_enqueue(frontier: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """The snapshot after enqueue_verdicts(): queued ones come in; one that is active already only lends its greater priority, lesser depth and its source."""
    from weir.operators.frontier import enqueue, merge_batch

    came = verdicts.where(F.col("verdict").isin("queued", "already-active")).withColumn("discovered_at", now)
    return enqueue(frontier, merge_batch(came))


def local_claims(queues: DataFrame, workers: DataFrame, leases: DataFrame, tombs: DataFrame, ready: DataFrame, now: Column, ttl_seconds: int = 30) -> DataFrame:
    """What each of workers(worker_id) claims, as if they asked one after another in the order of their ids: worker_id, url, source, expires_at.

    A worker that holds a living lease (worker_id, url, expires_at) renews it.  Else it takes the best URL of its own rows of
    queues(worker_id, url, priority, ord; worker_id null: the common queue), else of the common ones: by priority, then in the order of
    discovery.  Passed over are tombstoned URLs, URLs leased to another, and sites that are not ready (ready: site_key, ready_at), which
    a site no longer is once a worker before has claimed one of its URLs.

    The claims are matched in rounds.  Every worker without a site proposes to the best one that is free or held by a worker after it, and a
    site keeps the first worker that proposes; those turned down propose again.  Of the workers left to the common queue, which all
    prefer the same sites, the k-th proposes to the k-th site at once, if the workers before it can want no site but those ahead of it.  As
    proposals go down each worker's list and sites are only given up for workers before, this ends in the claims of the sequence."""
    alive = leases.where(F.col("expires_at") > now)
    asking = workers.select("worker_id").distinct()
    renewed = alive.join(asking, "worker_id", "left_semi").groupBy("worker_id").agg(F.min("url").alias("url"))
    asking = checkpointed(asking.join(renewed.select("worker_id"), "worker_id", "left_anti"))
    most = max(1, asking.count())
    cooling = ready.where(F.col("ready_at") > now).select("site_key").distinct()
    usable = queues.join(tombs.select("url").distinct(), "url", "left_anti").join(alive.select("url").distinct(), "url", "left_anti")
    usable = usable.withColumn("site_key", site_key(F.col("url"))).join(cooling, "site_key", "left_anti").withColumn("best", F.struct(-F.col("priority"), "ord", "url"))
    heads = checkpointed(usable.join(asking, "worker_id", "left_semi").groupBy("worker_id", "site_key").agg(F.min("best").alias("best")))
    # no worker can be turned down by more sites than there are other workers
    common = checkpointed(usable.where("worker_id is null").groupBy("site_key").agg(F.min("best").alias("best")).orderBy("best", "site_key").limit(most))
    held = asking.limit(0).select(F.lit("").alias("site_key"), "worker_id", F.lit("").alias("url"), F.lit("").alias("source"))
    found = None
    while True:
        taken = held.select("site_key", F.col("worker_id").alias("holder"))
        without = asking.join(held, "worker_id", "left_anti")
        open_to = lambda w: F.col("holder").isNull() | (F.col("holder") > w)
        own = heads.join(without, "worker_id").join(taken, "site_key", "left").where(open_to(F.col("worker_id"))).groupBy("worker_id").agg(F.min(F.struct("best", "site_key")).alias("b"))
        own = own.select("b.site_key", "worker_id", "b.best.url", F.lit("local").alias("source"))
        # both sides of the deal have as many rows as workers ask, at most
        waiting = without.join(own, "worker_id", "left_anti").withColumn("k", F.row_number().over(Window.orderBy("worker_id")))
        first = waiting.agg(F.min("worker_id").alias("first"))
        line = Window.orderBy("best", "site_key")
        offers = common.join(taken, "site_key", "left").join(F.broadcast(first)).where(open_to(F.col("first"))).withColumn("k", F.row_number().over(line)).withColumn("before", F.min("holder").over(line))
        dealt = waiting.join(offers, "k").where(F.col("before").isNull() | (F.col("before") > F.col("worker_id"))).select("site_key", "worker_id", "best.url", F.lit("global").alias("source"))
        every = held.unionByName(own).unionByName(dealt)
        held = checkpointed(every.groupBy("site_key").agg(F.min(F.struct("worker_id", "url", "source")).alias("h")).select("site_key", "h.*"))
        # a round without proposals changes neither
        now_found = held.agg(F.count(F.lit(1)), F.sum("worker_id")).first()
        if now_found == found:
            break
        found = now_found
    claims = renewed.withColumn("source", F.lit("renewed")).unionByName(held.select("worker_id", "url", "source"))
    return claims.withColumn("expires_at", now + F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def delivery(events: DataFrame, most: int = BUFFERED_EVENTS) -> DataFrame:
    """What becomes of buffered events (id, delivered: whether the receiver takes it now) sent in order of id: sent, up to the first that fails; of the rest the newest ``most`` stay pending, older ones are dropped."""
    failed = events.where(~F.coalesce("delivered", F.lit(False))).agg(F.min("id").alias("__first"))
    rows = events.crossJoin(F.broadcast(failed)).withColumn("__sent", F.coalesce(F.col("id") < F.col("__first"), F.lit(True)))
    kept = rows.where("not __sent").orderBy(F.desc("id")).limit(most).select("id", F.lit(True).alias("__kept"))
    outcome = F.when(F.col("__sent"), "sent").when(F.col("__kept"), "pending").otherwise("dropped")
    return rows.join(F.broadcast(kept), "id", "left").select("id", outcome.alias("outcome"))


def preferential_order(candidates: DataFrame, capacity: int = IN_MEMORY, topics: list[str] | None = None, hosts: list[str] | None = None) -> DataFrame:
    """Candidates (url, anchor, ord) of a frontier that pops the best score first: each URL once, with its priority and the batch it pops in.

    The first ``capacity`` (1,000 at least) to come are held in memory, batch 0; later ones are swapped, whatever their score, and come
    back in batches of up to ``SWAP_BATCH`` in the order they came, 1 and so on."""
    most = max(1000, capacity)
    size = min(SWAP_BATCH, most)
    first = numbered(candidates.groupBy("url").agg(F.min(F.struct("ord", "anchor")).alias("f")).select("url", "f.ord", "f.anchor"), "place", ["ord", "url"])
    score = scoring.preferential(F.col("url"), F.col("anchor"), topics, hosts)["score"]
    batch = F.when(F.col("place") <= most, 0).otherwise(F.ceil((F.col("place") - most) / size)).cast("long")
    return first.select("url", "place", score.alias("priority"), batch.alias("batch"))


def popped(entries: DataFrame, take: int) -> DataFrame:
    """The next entries of preferential_order(): a batch is used up before the next one; in it the greatest priority goes first, then the first to come."""
    return entries.orderBy("batch", F.desc("priority"), "place").limit(take)


def active_sites(*urls: DataFrame) -> DataFrame:
    """Site keys of queued URLs, leases and local queues (url each)."""
    out = urls[0].select("url")
    for more in urls[1:]:
        out = out.union(more.select("url"))
    return out.select(site_key(F.col("url")).alias("site_key")).distinct()


def stale_sites(registry: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of the access registry (site_key, …) whose site nothing is left of."""
    return registry.join(active.select("site_key"), "site_key", "left_anti")


def fetch_results(rows: DataFrame) -> DataFrame:
    """Fetched rows (url, robots_allowed, fetch_error, parse_error, status_code, final_url) with the stage they came to (robots, fetch, parse or complete), ok, error and status_code, which is 0 for what was not fetched."""
    blocked = ~F.coalesce("robots_allowed", F.lit(True))
    stage = F.when(blocked, "robots").when(F.col("fetch_error").isNotNull(), "fetch").when(F.col("parse_error").isNotNull(), "parse").otherwise("complete")
    error = F.when(blocked, "Blocked by robots.txt policy.").otherwise(F.coalesce("fetch_error", "parse_error"))
    fetched = stage.isin("parse", "complete")
    return rows.select("url", stage.alias("stage"), (stage == "complete").alias("ok"), error.alias("error"), F.when(fetched, F.coalesce("final_url", "url")).otherwise(F.col("url")).alias("final_url"), F.when(fetched, F.col("status_code")).otherwise(0).alias("status_code"))
