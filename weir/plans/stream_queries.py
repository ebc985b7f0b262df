"""Queries of streams that run to the end of a driver's table, each with the SQL of the same over the whole table.  Importing it adds them to the registry."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.operators.numbering import checkpoint_folder
from weir.plans.crawl_queries import _LEVEL, _LOGGED, _MESSAGE
from weir.plans.queries import NOW, QUERIES, SQL, query
from weir.sources.fixtures import VIEWS, base
from weir.streaming import arbitration, requests, retention
from weir.streaming import events as ev
from weir.streaming import leases as ls

__all__ = ["QUERIES", "SQL"]


def stream_of(spark, d: str, name: str) -> DataFrame:
    """A driver's table, a file or a folder of them, as a stream."""
    return spark.readStream.schema(base(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def scratch(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{checkpoint_folder(spark)}/weir-stream-{uuid.uuid4().hex}"


# --- leases -------------------------------------------------------------------------------------------------------------

def _lease_step(ttl: int, tomb: int) -> str:
    """One request of each URL against the state that the one before left, as a step of a recursion."""
    return f"""SELECT url, n, worker_id, action, ts, ord, gone, gone_at, outcome,
   CASE WHEN outcome IN ('leased', 'renewed') THEN worker_id WHEN outcome NOT IN ('completed', 'requeued') THEN held END AS holder,
   CASE WHEN outcome IN ('leased', 'renewed') THEN ts + INTERVAL {ttl} SECOND WHEN outcome NOT IN ('completed', 'requeued') AND held IS NOT NULL THEN until END AS until,
   CASE WHEN outcome = 'completed' THEN ts + INTERVAL {tomb} SECOND WHEN dead THEN tomb END AS tomb,
   CASE WHEN outcome IN ('queued', 'requeued') THEN true WHEN outcome = 'leased' THEN false ELSE q END AS queued
  FROM (SELECT *, CASE WHEN action IN ('complete', 'release') THEN CASE WHEN held IS NULL OR held <> worker_id THEN 'rejected' WHEN action = 'release' THEN 'requeued' ELSE 'completed' END
     WHEN dead THEN 'tombstoned' WHEN action = 'enqueue' THEN CASE WHEN held IS NOT NULL OR q THEN 'already-active' ELSE 'queued' END
     WHEN held <> worker_id THEN 'refused' WHEN held IS NOT NULL THEN 'renewed' WHEN q THEN 'leased' ELSE 'absent' END AS outcome
   FROM (SELECT r.url, r.n, r.worker_id, r.action, r.ts, r.ord, CASE WHEN s.until >= r.ts THEN s.holder END AS held, CASE WHEN s.until < r.ts THEN s.holder END AS gone, CASE WHEN s.until < r.ts THEN s.until END AS gone_at,
     s.until, s.tomb, coalesce(s.tomb >= r.ts, false) AS dead, s.queued OR coalesce(s.until < r.ts, false) AS q FROM s JOIN r ON r.url = s.url AND r.n = s.n + 1))"""


_LEASE_TTL, _LEASE_TOMB = 6 * 3600, 24 * 3600


@query(f"""WITH RECURSIVE r AS (SELECT 'u' || CAST(event_id % 97 AS VARCHAR) AS url, user_id % 2 AS worker_id, CASE event_type WHEN 'view' THEN 'enqueue' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'release' ELSE 'lease' END AS action, ts, event_id AS ord,
  row_number() OVER (PARTITION BY event_id % 97 ORDER BY ts, event_id) AS n FROM events),
 s AS (SELECT DISTINCT url, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS worker_id, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS gone, CAST(NULL AS TIMESTAMP) AS gone_at, CAST(NULL AS VARCHAR) AS outcome,
   CAST(NULL AS BIGINT) AS holder, CAST(NULL AS TIMESTAMP) AS until, CAST(NULL AS TIMESTAMP) AS tomb, false AS queued FROM r UNION ALL {_lease_step(_LEASE_TTL, _LEASE_TOMB)})
SELECT url, worker_id, action, outcome, ts AS at, ord FROM s WHERE n > 0 UNION ALL SELECT url, gone, 'expire', 'requeued', gone_at, NULL FROM s WHERE gone IS NOT NULL
UNION ALL SELECT url, holder, 'expire', 'requeued', until, NULL FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY n DESC) AS last FROM s) WHERE last = 1 AND until < (SELECT max(ts) FROM r) - INTERVAL 600 SECOND""")
def stream_lease_life(spark, d):
    action = F.when(F.col("event_type") == "view", "enqueue").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "release").otherwise("lease")
    rows = stream_of(spark, d, "events").select(F.concat(F.lit("u"), (F.col("event_id") % 97).cast("string")).alias("url"), (F.col("user_id") % 2).alias("worker_id"), action.alias("action"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"))
    out = ev.run_to_end(ls.leases(rows, _LEASE_TTL, _LEASE_TOMB), "append", f"lease_life_{abs(hash(d))}", store=ls.STORE)
    return out.select("url", "worker_id", "action", "outcome", F.col("at").cast("timestamp_ntz").alias("at"), "ord")


# --- arbitration --------------------------------------------------------------------------------------------------------

@query("""WITH a AS (SELECT DISTINCT 'S' || CAST(sale_id % 3 AS VARCHAR) AS seed_url, client_id AS worker_id, sold_at AS assigned_at FROM sales WHERE sold_at IS NOT NULL), c AS (SELECT client_id AS worker_id, 's' || CAST(click_id % 3 AS VARCHAR) AS url, ts AS claimed_at FROM clicks WHERE ts IS NOT NULL),
 m AS (SELECT least((SELECT max(assigned_at) FROM a), (SELECT max(claimed_at) FROM c)) - INTERVAL 1 MINUTE AS mark),
 j AS (SELECT a.seed_url, a.worker_id, a.assigned_at, min((c.claimed_at, c.url)) FILTER (c.url IS NOT NULL) AS first FROM a LEFT JOIN c ON a.worker_id = c.worker_id AND c.claimed_at >= a.assigned_at AND c.claimed_at <= a.assigned_at + INTERVAL 24 HOUR GROUP BY ALL)
SELECT seed_url, worker_id, assigned_at, CASE WHEN first IS NULL THEN 'pending' WHEN lower(first[2]) = lower(seed_url) THEN 'completed' ELSE 'conflict' END AS outcome FROM j, m WHERE assigned_at + INTERVAL 24 HOUR < mark""")
def stream_arbitration(spark, d):
    assigned = stream_of(spark, d, "sales").where("sold_at IS NOT NULL").select(F.concat(F.lit("S"), (F.col("sale_id") % 3).cast("string")).alias("seed_url"), F.col("client_id").alias("worker_id"), F.col("sold_at").cast("timestamp").alias("assigned_at"))
    claims = stream_of(spark, d, "clicks").where("ts IS NOT NULL").select(F.col("client_id").alias("worker_id"), F.concat(F.lit("s"), (F.col("click_id") % 3).cast("string")).alias("url"), F.col("ts").cast("timestamp").alias("claimed_at"))
    out = ev.run_to_end(arbitration.arbitrated(assigned, claims, "24 hours"), "append", f"arbitration_{abs(hash(d))}", store=ls.STORE)
    return out.select("seed_url", "worker_id", F.col("assigned_at").cast("timestamp_ntz").alias("assigned_at"), "outcome")


# --- ingest requests ----------------------------------------------------------------------------------------------------

_BODY = "k int, device struct<os string, ver string>, tags array<string>, items array<struct<sku int, qty int>>"
_REASON = """CASE WHEN trim(coalesce(props, '')) = '' THEN 'empty' WHEN NOT json_valid(props) THEN 'malformed' WHEN json_type(props) <> 'OBJECT' THEN 'not-an-object'
 WHEN json_type(props, '$.k') = 'VARCHAR' THEN 'wrong-type' WHEN coalesce(json_type(props, '$.k'), 'NULL') = 'NULL' THEN 'incomplete' END"""


@query(f"""WITH j AS (SELECT click_id, arrived_at, props, {_REASON} AS reason FROM clicks)
SELECT click_id, arrived_at, CASE WHEN reason IS NOT NULL THEN props END AS body, reason, CASE WHEN reason IS NULL THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k, CASE WHEN reason IS NULL THEN json_extract_string(props, '$.device.os') END AS os,
 CASE WHEN reason IS NULL AND json_type(props, '$.items') = 'ARRAY' THEN CAST(json_array_length(props, '$.items') AS INT) END AS n_items FROM j""")
def stream_dead_letters(spark, d):
    rows = stream_of(spark, d, "clicks").select("click_id", "arrived_at", F.col("props").alias("body"))
    folder = scratch(spark)
    requests.stored(requests.judged(rows, _BODY, F.col("request.k").isNotNull()), f"{folder}/out", f"{folder}/state").awaitTermination()
    good = spark.read.parquet(f"{folder}/out/accepted/batch=*").select("click_id", "arrived_at", F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("reason"), "request.k", F.col("request.device.os").alias("os"), F.when(F.col("request.items").isNotNull(), F.size("request.items")).alias("n_items"))
    bad = spark.read.parquet(f"{folder}/out/dead_letter/batch=*").select("click_id", "arrived_at", "body", "reason", F.lit(None).cast("int").alias("k"), F.lit(None).cast("string").alias("os"), F.lit(None).cast("int").alias("n_items"))
    return good.unionByName(bad)


@query("""WITH b AS (SELECT page_id, url, CASE WHEN page_id % 13 = 5 THEN 'malformed' WHEN page_id % 19 = 4 THEN 'incomplete' WHEN page_id % 17 = 3 THEN 'wrong-type' END AS reason, html FROM pages)
SELECT page_id, reason, CASE WHEN reason IS NULL THEN regexp_replace(url, '#.*$', '') END AS url, CASE WHEN reason IS NULL THEN sha256(html) END AS html_sha256, CASE WHEN reason IS NULL THEN CASE WHEN page_id % 3 = 0 THEN 'BINARY' ELSE 'HTML' END END AS page_type_code FROM b""")
def stream_ingest_requests(spark, d):
    status = F.when(F.col("page_id") % 17 == 3, "none").otherwise("200")
    result = F.struct(F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("finalUrl"), status.alias("statusCode"), F.when(F.col("page_id") % 3 == 0, " binary ").alias("pageTypeCode"), F.col("html").alias("htmlContent"))
    gone = F.col("page_id") % 19 == 4
    body = F.to_json(F.struct(F.when(~gone, F.col("url")).alias("rawUrl"), F.col("page_id").cast("int").alias("siteId"), F.array(F.lit("http://a.example/")).alias("discoveredUrls"), F.when(~gone, result).alias("downloadResult")))
    body = F.regexp_replace(body, '"statusCode":"(\\d+)"', '"statusCode":$1')
    rows = stream_of(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 13 == 5, F.substring(body, 1, 40)).otherwise(body).alias("body"), F.lit(dt.datetime.fromisoformat(NOW)).alias("received_at"))
    folder = scratch(spark)
    requests.stored(requests.ingest_requests(rows), f"{folder}/out", f"{folder}/state").awaitTermination()
    good = spark.read.parquet(f"{folder}/out/accepted/batch=*")
    told = good.select("page_id", F.lit(None).cast("string").alias("reason"), requests.page_url().alias("url"), F.sha2("request.downloadResult.htmlContent", 256).alias("html_sha256"), requests.page_kind().alias("page_type_code"))
    none = F.lit(None).cast("string")
    return told.unionByName(spark.read.parquet(f"{folder}/out/dead_letter/batch=*").select("page_id", "reason", none.alias("url"), none.alias("html_sha256"), none.alias("page_type_code")))


# --- tables by day ------------------------------------------------------------------------------------------------------

_CUT = {"worker_log": 14, "worker_metric": 9}


@query(f"""WITH l AS (SELECT 'worker_log' AS name, ts, {_LEVEL} || ' ' || {_MESSAGE} AS said FROM v_event WHERE {_LOGGED}), m AS (SELECT 'worker_metric' AS name, ts, CASE WHEN type = 'page-reported' THEN 'page_processed' ELSE 'pages_processed_total' END AS said FROM v_event WHERE type IN ('page-reported', 'worker-metric'))
SELECT name, CAST(ts AS DATE) AS day, count(*) AS n, min(said) AS first, max(said) AS last FROM (SELECT * FROM l WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY UNION ALL SELECT * FROM m WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 9 DAY) GROUP BY name, day""")
def stream_retention(spark, d):
    stream_of(spark, d, "events").createOrReplaceTempView("events")
    rows = ev.envelopes(spark.sql(VIEWS["v_event"]).select("type", F.lit(None).cast("string").alias("daemonId"), F.col("worker_id").cast("int").alias("workerId"), "payload", "ts"))
    folder = scratch(spark)
    ev.persist(rows, f"{folder}/out", f"{folder}/state").awaitTermination()
    retention.clean(spark, f"{folder}/out", dt.datetime.fromisoformat(NOW), kept_days=_CUT)
    kept = None
    for name, said in (("worker_log", F.concat_ws(" ", "level", "message")), ("worker_metric", F.col("metric_name"))):
        own = spark.read.parquet(f"{folder}/out/{name}").select(F.lit(name).alias("name"), "day", said.alias("said"))
        kept = own if kept is None else kept.unionByName(own)
    return kept.groupBy("name", "day").agg(F.count(F.lit(1)).alias("n"), F.min("said").alias("first"), F.max("said").alias("last"))
