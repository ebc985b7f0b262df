"""Queries of transitions, workers, events and graph views, each with its SQL.  Importing it adds them to the registry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.functions import hashing, robots, scoring, telemetry
from weir.functions import url as U
from weir.operators import activity, frontier, graph, ingest, worker
from weir.operators import pages as P
from weir.operators.numbering import checkpoint_folder, checkpointed
from weir.plans import pipelines
from weir.plans.queries import _GRAPH, NOW, QUERIES, SQL, now, query, sitemap_documents
from weir.sources.fixtures import VIEWS, base, view
from weir.streaming import events as ev

__all__ = ["QUERIES", "SQL"]

POLICY = scoring.Policy(keywords=["clinic", "health", "img"], suffixes=["gov.example.org", ".c7.example.org"])
TS = f"TIMESTAMP '{NOW}'"

# --- the frontier -------------------------------------------------------------------------------------------------------

_BATCH = "b AS (SELECT url, priority + 1 AS priority, 0 AS depth, discovered_at FROM v_frontier WHERE id % 3 = 0 UNION ALL SELECT 'https://new.example.org/' || CAST(id AS VARCHAR), 5, 0, discovered_at FROM v_frontier WHERE id % 50 = 0)"


def _came_again(f) -> DataFrame:
    """A batch of what a frontier has already, and of new URLs."""
    new = lambda url, rows, p: rows.select(url.alias("url"), p.alias("priority"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("source_url"), "discovered_at", F.col("id").alias("ord"))
    return new(F.col("url"), f.where("id % 3 = 0"), F.col("priority") + 1).union(new(F.concat(F.lit("https://new.example.org/"), F.col("id").cast("string")), f.where("id % 50 = 0"), F.lit(5)))


def _enqueued(spark, d, keep_terminal: bool) -> DataFrame:
    f = view(spark, d, "v_frontier").withColumn("source_url", F.lit(None).cast("string"))
    return frontier.enqueue(f, frontier.merge_batch(_came_again(f)), keep_terminal)


@query(f"""WITH {_BATCH} SELECT coalesce(f.url, b.url) AS url, greatest(f.priority, b.priority) AS priority, least(f.depth, b.depth) AS depth,
 CASE WHEN f.url IS NULL OR (b.url IS NOT NULL AND f.state NOT IN ('COMPLETED', 'FAILED', 'DUPLICATE')) THEN 'QUEUED' ELSE f.state END AS state FROM v_frontier f FULL JOIN b ON f.url = b.url""")
def frontier_upsert_offline(spark, d):
    return _enqueued(spark, d, True).select("url", "priority", "depth", "state")


@query(f"""WITH {_BATCH}, n AS (SELECT b.url FROM b LEFT JOIN v_frontier f ON f.url = b.url WHERE f.url IS NULL)
SELECT (SELECT max(id) FROM v_frontier) + row_number() OVER (ORDER BY url) AS id, url FROM n UNION ALL SELECT id, url FROM v_frontier""")
def frontier_new_ids(spark, d):
    return _enqueued(spark, d, False).select("id", "url")


_HEADS = "h AS (SELECT *, row_number() OVER (ORDER BY priority DESC, discovered_at, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY priority DESC, discovered_at, id) AS r FROM v_frontier WHERE state = 'QUEUED') WHERE r = 1)"


@query(f"""WITH {_HEADS} SELECT f.id, CASE WHEN rank <= 2 THEN 'LOCKED' ELSE f.state END AS state, CASE WHEN rank <= 2 THEN {TS} ELSE f.locked_at END AS locked_at, CASE WHEN rank = 1 THEN 9101 WHEN rank = 2 THEN 9102 ELSE f.locked_by_worker_id END AS locked_by_worker_id
 FROM v_frontier f LEFT JOIN h ON h.id = f.id""")
def frontier_claim(spark, d):
    f = view(spark, d, "v_frontier")
    return frontier.claim(f, frontier.dequeue(f, [9101, 9102], 2, now()), now()).select("id", "state", "locked_at", "locked_by_worker_id")


@query(f"""WITH {_HEADS} SELECT site_key, id FROM h WHERE site_key NOT IN ('h3.example.org', 'h4.example.org')""")
def frontier_ready_heads(spark, d):
    ready = base(spark, d, "nation").select(F.concat(F.lit("h"), F.col("n_nationkey").cast("string"), F.lit(".example.org")).alias("site_key"), F.when(F.col("n_nationkey").isin(3, 4), now() + F.expr("INTERVAL 1 SECOND")).otherwise(now()).alias("ready_at"))
    return frontier.heads(view(spark, d, "v_frontier"), ready, now()).select("site_key", "id")


@query("SELECT count(*) FILTER (state IN ('LOCKED', 'PROCESSING')) AS n FROM v_frontier")
def frontier_locked_total(spark, d):
    return frontier.locked_total(view(spark, d, "v_frontier"))


def _registry(spark, d) -> DataFrame:
    return base(spark, d, "customer").select(F.concat(F.lit("c"), (F.col("c_custkey") % 7).cast("string")).alias("crawler"), F.concat(F.lit("h"), (F.col("c_custkey") % 300).cast("string")).alias("site_key"), (now() + F.make_dt_interval(secs=(F.col("c_custkey") % 90 - 30))).alias("ready_at"))


_REG = f"r AS (SELECT 'c' || CAST(c_custkey % 7 AS VARCHAR) AS crawler, 'h' || CAST(c_custkey % 300 AS VARCHAR) AS site_key, {TS} + CAST(c_custkey % 90 - 30 AS INT) * INTERVAL 1 SECOND AS ready_at FROM customer)"


@query(f"""WITH {_REG}, o AS (SELECT 'c' || CAST(s_suppkey % 7 AS VARCHAR) AS crawler, 'h' || CAST(s_suppkey AS VARCHAR) AS site_key, {TS} + CAST(greatest(5000, s_suppkey * 700) AS INT) * INTERVAL 1 MILLISECOND AS ready_at FROM supplier)
SELECT crawler, site_key, max(ready_at) AS ready_at FROM (SELECT * FROM r UNION ALL SELECT * FROM o) GROUP BY crawler, site_key HAVING max(ready_at) > {TS}""")
def site_cooldowns(spark, d):
    seen = base(spark, d, "supplier").select(F.concat(F.lit("c"), (F.col("s_suppkey") % 7).cast("string")).alias("crawler"), F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("site_key"), (F.col("s_suppkey") * 700).alias("delay_ms"))
    return frontier.cooldowns(_registry(spark, d), seen, now())


@query(f"""WITH {_REG}, g AS (SELECT site_key, max(ready_at) AS ready_at FROM r GROUP BY site_key)
SELECT site_key, CAST(epoch(ready_at - {TS}) AS DOUBLE) AS remaining FROM g WHERE ready_at > {TS} ORDER BY remaining DESC, lower(site_key) LIMIT 12""")
def active_ip_timeouts(spark, d):
    rows = _registry(spark, d).groupBy("site_key").agg(F.max("ready_at").alias("ready_at"))
    return frontier.active_timeouts(rows, now()).select("site_key", "remaining")


@query(f"""WITH {_REG}, g AS (SELECT site_key, max(ready_at) AS ready_at FROM r GROUP BY site_key),
 n AS (SELECT site_key, list_sort(list(DISTINCT host))[1:6] AS hosts FROM (SELECT 'h' || CAST(s_suppkey % 60 AS VARCHAR) AS site_key, 'host' || CAST(s_suppkey AS VARCHAR) AS host FROM supplier) GROUP BY site_key)
SELECT g.site_key, CAST(epoch(ready_at - {TS}) AS DOUBLE) AS remaining, array_to_string(hosts, ',') AS hosts FROM g LEFT JOIN n USING (site_key) WHERE ready_at > {TS} ORDER BY remaining DESC, g.site_key LIMIT 128""")
def cooldown_snapshot(spark, d):
    rows = _registry(spark, d).groupBy("site_key").agg(F.max("ready_at").alias("ready_at"))
    hosts = base(spark, d, "supplier").select(F.concat(F.lit("h"), (F.col("s_suppkey") % 60).cast("string")).alias("site_key"), F.concat(F.lit("HOST"), F.col("s_suppkey").cast("string")).alias("host"))
    return frontier.cooldown_snapshot(rows, hosts, now()).select("site_key", "remaining", F.array_join("hosts", ",").alias("hosts"))


@query("""WITH q AS (SELECT id, o_custkey % 400 AS ip, ts FROM (SELECT o_orderkey AS id, o_custkey, o_orderdate AS ts FROM orders)),
 g AS (SELECT id, ip, epoch(ts - lag(ts) OVER (PARTITION BY ip ORDER BY ts, id)) AS gap FROM q) SELECT ip, count(*) AS n FROM g WHERE gap < 86400 * 3 GROUP BY ip""")
def politeness_violations(spark, d):
    rows = base(spark, d, "orders").select((F.col("o_custkey") % 400).alias("ip"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return frontier.violations(rows, 86400 * 3).groupBy("ip").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, host FROM (SELECT id, site_key AS host FROM v_frontier) WHERE host = 'h7.example.org' OR host LIKE '%.h7.example.org' OR host = 'h12.example.org'")
def allowed_hosts(spark, d):
    return frontier.allowed_hosts(view(spark, d, "v_frontier").select("id", F.col("site_key").alias("host")), ["h7.example.org", " H12.example.org "])


@query("SELECT url, CAST(greatest(10, 101 - row_number() OVER (ORDER BY ord, url)) AS INT) AS priority FROM (SELECT url, min(ord) AS ord FROM v_found GROUP BY url)")
def seed_priorities(spark, d):
    return frontier.seed_priorities(view(spark, d, "v_found").select("url", "ord")).select("url", F.col("priority").cast("int").alias("priority"))


# --- a worker's own queue -----------------------------------------------------------------------------------------------

_CRAWLER_SCORE = "CASE WHEN regexp_extract(source_url, '^https?://([^/:?#]+)', 1) = h THEN 10.0 ELSE 0.0 END + CASE WHEN h = 'gov.example.org' OR h LIKE '%.gov.example.org' OR h = 'c7.example.org' OR h LIKE '%.c7.example.org' THEN 20.0 ELSE 0.0 END + CASE WHEN contains(p, 'clinic') THEN 5.0 ELSE 0.0 END + CASE WHEN contains(p, 'health') THEN 5.0 ELSE 0.0 END + CASE WHEN contains(p, 'img') THEN 5.0 ELSE 0.0 END - 0.2 * depth"
_SCORED = f"s AS (SELECT *, {_CRAWLER_SCORE} AS score FROM (SELECT *, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS h, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM v_found))"


@query(f"WITH {_SCORED} SELECT ord, round(CAST(score AS DOUBLE), 6) AS score, CAST(round_even(CAST(score AS DOUBLE), 0) AS INT) AS priority FROM s")
def crawler_scores(spark, d):
    score = scoring.crawler_score(F.col("url"), F.col("source_url"), F.col("depth"), POLICY)
    return view(spark, d, "v_found").select("ord", F.round(score, 6).alias("score"), scoring.crawler_priority(score).alias("priority"))


def _worker_frontier(spark, d) -> DataFrame:
    columns = "source_url", "depth"
    rows = view(spark, d, "v_found").where("ord % 11 < 4").groupBy("url").agg(F.min("ord").alias("id"), F.lit(3).alias("priority"), *[F.min_by(c, "ord").alias(c) for c in columns], F.min("found_at").alias("discovered_at"))
    return rows.withColumn("state", F.element_at(F.array(*[F.lit(s) for s in ("QUEUED", "COMPLETED", "LOCKED", "FAILED")]), (F.col("id") % 4 + 1).cast("int")))


def _verdicts(spark, d) -> DataFrame:
    found = view(spark, d, "v_found")
    tombs = worker.tombstones(found.where("ord % 13 = 0").select("url", F.col("found_at").alias("finished_at")), F.expr("TIMESTAMP_NTZ '1998-06-01 00:00:00'"))
    rows = found.select("url", "source_url", "depth", F.when(F.col("ord") % 4 == 0, (F.col("ord") % 100).cast("int")).alias("priority"), (F.col("ord") % 9 != 0).alias("robots_allowed"), "ord")
    return worker.enqueue_verdicts(rows, _worker_frontier(spark, d), tombs, POLICY)


_VERDICTS = f"""{_SCORED}, wf AS (SELECT url, min(ord) AS id FROM v_found WHERE ord % 11 < 4 GROUP BY url), tomb AS (SELECT DISTINCT url FROM v_found WHERE ord % 13 = 0 AND found_at > TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 600 SECOND),
 j AS (SELECT s.*, tomb.url IS NOT NULL AS dead, ord % 9 <> 0 AS ok, coalesce(wf.id % 4 IN (0, 2), false) AS active, CASE WHEN ord % 4 = 0 THEN CAST(ord % 100 AS INT) ELSE CAST(round_even(CAST(score AS DOUBLE), 0) AS INT) END AS pri FROM s LEFT JOIN tomb ON tomb.url = s.url LEFT JOIN wf ON wf.url = s.url),
 v AS (SELECT *, CASE WHEN dead THEN 'tombstoned' WHEN NOT ok THEN 'robots-disallow' WHEN active OR coalesce(ord > min(CASE WHEN NOT dead AND ok THEN ord END) OVER (PARTITION BY url), false) THEN 'already-active' ELSE 'queued' END AS verdict FROM j)"""


@query(f"WITH {_VERDICTS} SELECT ord, pri AS priority, verdict FROM v")
def local_enqueue_verdicts(spark, d):
    return _verdicts(spark, d).select("ord", "priority", "verdict")


@query(f"""WITH {_VERDICTS}, m AS (SELECT url, max(pri) AS priority FROM v WHERE verdict IN ('queued', 'already-active') GROUP BY url), w AS (SELECT url, id % 4 AS k FROM wf)
SELECT coalesce(w.url, m.url) AS url, greatest(CASE WHEN w.url IS NOT NULL THEN 3 END, m.priority) AS priority, CASE WHEN w.url IS NULL THEN 'QUEUED' WHEN k = 0 THEN 'QUEUED' WHEN k = 2 THEN 'LOCKED' WHEN m.url IS NOT NULL THEN 'QUEUED' WHEN k = 1 THEN 'COMPLETED' ELSE 'FAILED' END AS state FROM w FULL JOIN m ON w.url = m.url""")
def local_enqueue(spark, d):
    return worker.local_enqueue(_worker_frontier(spark, d), _verdicts(spark, d), F.expr("TIMESTAMP_NTZ '1999-01-01 00:00:00'")).select("url", "priority", "state")


@query("""WITH RECURSIVE q AS (SELECT CASE WHEN ord % 3 = 0 THEN NULL ELSE ord % 40 END AS worker_id, url, priority, ord FROM (SELECT *, CAST(ord % 17 AS INT) AS priority FROM v_found) UNION ALL SELECT ord % 7, url, 20, ord FROM v_found WHERE ord % 23 = 0),
 lease AS (SELECT ord % 40 AS worker_id, url FROM v_found WHERE ord % 301 = 0), cool AS (SELECT 'c' || CAST(n_nationkey AS VARCHAR) || '.example.org' AS site_key FROM nation WHERE n_nationkey % 2 = 0),
 ren AS (SELECT worker_id, min(url) AS url FROM lease WHERE worker_id IN (SELECT worker_id FROM v_worker) GROUP BY worker_id),
 h AS (SELECT worker_id, site_key, min((-priority, ord, url)) AS best FROM (SELECT *, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS site_key FROM q) WHERE url NOT IN (SELECT url FROM v_found WHERE ord % 29 = 0) AND url NOT IN (SELECT url FROM lease) AND site_key NOT IN (SELECT site_key FROM cool) GROUP BY ALL),
 w AS (SELECT worker_id, row_number() OVER (ORDER BY worker_id) AS k FROM v_worker WHERE worker_id NOT IN (SELECT worker_id FROM ren)),
 c AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS worker_id, CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS source, CAST([] AS VARCHAR[]) AS sites
  UNION ALL SELECT k, worker_id, b[3][3], CASE WHEN b[1] = 0 THEN 'local' WHEN b[1] = 1 THEN 'global' END, CASE WHEN b IS NULL THEN sites ELSE list_append(sites, b[2]) END FROM
   (SELECT w.k, w.worker_id, c.sites, arg_min((CASE WHEN h.worker_id IS NULL THEN 1 ELSE 0 END, h.site_key, h.best), (CASE WHEN h.worker_id IS NULL THEN 1 ELSE 0 END, h.best)) FILTER (h.site_key IS NOT NULL) AS b
    FROM c JOIN w ON w.k = c.k + 1 LEFT JOIN h ON (h.worker_id = w.worker_id OR h.worker_id IS NULL) AND NOT list_contains(c.sites, h.site_key) GROUP BY w.k, w.worker_id, c.sites))
SELECT worker_id, url, 'renewed' AS source FROM ren UNION ALL SELECT worker_id, url, source FROM c WHERE url IS NOT NULL""")
def local_claims(spark, d):
    found = view(spark, d, "v_found")
    queues = found.select(F.when(F.col("ord") % 3 != 0, F.col("ord") % 40).alias("worker_id"), "url", (F.col("ord") % 17).cast("int").alias("priority"), "ord")
    queues = queues.unionByName(found.where("ord % 23 = 0").select((F.col("ord") % 7).alias("worker_id"), "url", F.lit(20).alias("priority"), "ord"))
    leases = found.where("ord % 301 = 0").select((F.col("ord") % 40).alias("worker_id"), "url", (now() + F.expr("INTERVAL 5 SECONDS")).alias("expires_at"))
    ready = base(spark, d, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string"), F.lit(".example.org")).alias("site_key"), F.when(F.col("n_nationkey") % 2 == 0, now() + F.expr("INTERVAL 9 SECONDS")).otherwise(now()).alias("ready_at"))
    return worker.local_claims(queues, view(spark, d, "v_worker").select("worker_id"), leases, found.where("ord % 29 = 0").select("url"), ready, now()).select("worker_id", "url", "source")


@query("""WITH f AS (SELECT min(id) FILTER (id % 4999 = 4998) AS x FROM v_event), r AS (SELECT id, id < coalesce(x, id + 1) AS sent FROM v_event, f)
SELECT id, CASE WHEN sent THEN 'sent' WHEN row_number() OVER (PARTITION BY sent ORDER BY id DESC) <= 1000 THEN 'pending' ELSE 'dropped' END AS outcome FROM r""")
def event_delivery(spark, d):
    return worker.delivery(view(spark, d, "v_event").select("id", (F.col("id") % 4999 != 4998).alias("delivered")))


_PREF = "p AS (SELECT url, ord, row_number() OVER (ORDER BY ord, url) AS place, 50 + CASE WHEN contains(lower(url), 'clinic') THEN 40 ELSE 0 END + CASE WHEN contains(regexp_extract(url, '^https?://([^/:?#]+)', 1), 'c7.') THEN 20 ELSE 0 END - CASE WHEN regexp_matches(lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)), '\\.(pdf|docx?|pptx?)$') THEN 35 ELSE 0 END - CASE WHEN contains(lower(url), '/news') THEN 15 ELSE 0 END AS priority FROM (SELECT url, min(ord) AS ord FROM v_found GROUP BY url)), e AS (SELECT url, place, priority, CASE WHEN place <= 1000 THEN 0 ELSE CAST(ceil((place - 1000) / 1000.0) AS BIGINT) END AS batch FROM p)"


def _preferential(spark, d) -> DataFrame:
    rows = view(spark, d, "v_found").select("url", F.lit(None).cast("string").alias("anchor"), "ord")
    return worker.preferential_order(rows, 1000, ["clinic"], ["c7."])


@query(f"WITH {_PREF} SELECT url, priority, batch FROM e")
def preferential_frontier(spark, d):
    return _preferential(spark, d).select("url", "priority", "batch")


@query(f"WITH {_PREF} SELECT url, priority, batch FROM e ORDER BY batch, priority DESC, place LIMIT 1500")
def preferential_pops(spark, d):
    return worker.popped(_preferential(spark, d), 1500).select("url", "priority", "batch")


@query("WITH a AS (SELECT site_key FROM v_frontier WHERE state = 'QUEUED' UNION SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) FROM v_found WHERE ord % 9 = 0) SELECT site_key FROM a")
def active_site_keys(spark, d):
    return worker.active_sites(view(spark, d, "v_frontier").where("state = 'QUEUED'"), view(spark, d, "v_found").where("ord % 9 = 0"))


@query("SELECT c_custkey AS id FROM customer WHERE 'h' || CAST(c_custkey % 40 AS VARCHAR) || '.example.org' NOT IN (SELECT site_key FROM v_frontier WHERE state = 'QUEUED')")
def stale_site_keys(spark, d):
    registry = base(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("h"), (F.col("c_custkey") % 40).cast("string"), F.lit(".example.org")).alias("site_key"))
    return worker.stale_sites(registry, worker.active_sites(view(spark, d, "v_frontier").where("state = 'QUEUED'"))).select("id")


@query("""SELECT event_id AS id, CASE WHEN event_type = 'signup' THEN 'robots' WHEN event_type = 'error' THEN 'fetch' WHEN value > 60 THEN 'parse' ELSE 'complete' END AS stage, event_type NOT IN ('signup', 'error') AND value <= 60 AS ok,
 CASE WHEN event_type = 'signup' THEN 'Blocked by robots.txt policy.' WHEN event_type = 'error' THEN 'failed with ' || props WHEN value > 60 THEN 'too long: ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS error,
 CASE WHEN event_type IN ('signup', 'error') THEN 'http://u/' || CAST(event_id AS VARCHAR) ELSE coalesce(CASE WHEN user_id % 2 = 0 THEN 'http://u/' || CAST(user_id AS VARCHAR) END, 'http://u/' || CAST(event_id AS VARCHAR)) END AS final_url, CASE WHEN event_type IN ('signup', 'error') THEN 0 ELSE CAST(200 + floor(value) AS INT) END AS status_code FROM events""")
def fetch_stages(spark, d):
    url = lambda c: F.concat(F.lit("http://u/"), F.col(c).cast("string"))
    said = {"url": url("event_id"), "robots_allowed": F.col("event_type") != "signup", "fetch_error": F.when(F.col("event_type") == "error", F.concat(F.lit("failed with "), "props")), "parse_error": F.when(F.col("value") > 60, F.concat(F.lit("too long: "), F.floor("value").cast("string"))), "status_code": (200 + F.floor("value")).cast("int"), "final_url": F.when(F.col("user_id") % 2 == 0, url("user_id"))}
    out = worker.fetch_results(base(spark, d, "events").select("event_id", *[c.alias(n) for n, c in said.items()]))
    return out.select(F.regexp_extract("url", "(\\d+)$", 1).cast("long").alias("id"), "stage", "ok", "error", "final_url", "status_code")


# --- ingest -------------------------------------------------------------------------------------------------------------

def _known_pages(spark, d) -> DataFrame:
    """A page for every other document, HTML or still to be fetched, of which one in five has the text of another."""
    rows = view(spark, d, "v_content").where("id % 2 = 0").select("id", "url", F.when(F.col("id") % 6 == 0, "FRONTIER").otherwise("HTML").alias("page_type_code"), F.when(F.col("id") % 6 != 0, F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("html_content"))
    return rows.select("*", F.sha2("html_content", 256).alias("content_hash"), F.lit(None).cast("long").alias("duplicate_of_page_id"), F.lit(None).cast("timestamp_ntz").alias("accessed_time"))


def _came(spark, d) -> DataFrame:
    return view(spark, d, "v_content").where("id % 3 <> 1").select(F.concat("url", F.lit("#x")).alias("url"), F.lit("HTML").alias("page_type_code"), F.concat(F.lit("t"), (F.col("id") % 500).cast("string")).alias("html_content"), now().alias("accessed_time"))


@query("""WITH k AS (SELECT id, url, CASE WHEN id % 6 = 0 THEN 'FRONTIER' ELSE 'HTML' END AS t, CASE WHEN id % 6 <> 0 THEN 't' || CAST(id % 700 AS VARCHAR) END AS html FROM v_content WHERE id % 2 = 0),
 c AS (SELECT DISTINCT url, 't' || CAST(id % 500 AS VARCHAR) AS html FROM v_content WHERE id % 3 <> 1),
 n AS (SELECT url, (SELECT max(id) FROM k) + row_number() OVER (ORDER BY url) AS id FROM c WHERE url NOT IN (SELECT url FROM k)),
 b AS (SELECT coalesce(k.id, n.id) AS id, coalesce(k.url, c.url) AS url, k.id IS NULL AS fresh, k.t AS old_type, CASE WHEN c.url IS NOT NULL THEN 'HTML' ELSE k.t END AS now_type, c.url IS NOT NULL AS has, coalesce(c.html, k.html) AS html, c.html AS new_html FROM k FULL JOIN c ON k.url = c.url LEFT JOIN n ON n.url = c.url),
 first AS (SELECT html, min(id) AS f FROM b WHERE now_type = 'HTML' AND html IS NOT NULL GROUP BY html),
 o AS (SELECT b.*, first.f FROM b LEFT JOIN first ON b.new_html = first.html AND first.f < b.id)
SELECT id, url, CASE WHEN f IS NOT NULL THEN 'DUPLICATE' ELSE now_type END AS page_type_code, f AS duplicate_of_page_id, CASE WHEN f IS NULL THEN html END AS html_content,
 CASE WHEN has AND fresh THEN CASE WHEN f IS NOT NULL THEN 'duplicate_content' ELSE 'inserted' END WHEN has AND old_type = 'FRONTIER' THEN CASE WHEN f IS NOT NULL THEN 'promoted_duplicate' ELSE 'promoted' END WHEN has THEN CASE WHEN f IS NOT NULL THEN 'updated_duplicate' ELSE 'updated' END END AS status FROM o""")
def ingest_upsert(spark, d):
    return ingest.upsert_pages(_known_pages(spark, d), _came(spark, d)).select("id", "url", "page_type_code", "duplicate_of_page_id", "html_content", "status")


@query("""WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS domain FROM v_found), n AS (SELECT domain FROM h WHERE domain NOT IN (SELECT domain FROM v_site))
SELECT id, domain FROM v_site UNION ALL SELECT (SELECT max(id) FROM v_site) + row_number() OVER (ORDER BY domain), domain FROM n""")
def sites_after_ingest(spark, d):
    return ingest.sites_of(view(spark, d, "v_found").select("url"), view(spark, d, "v_site").select(F.col("id").cast("long").alias("id"), "domain"))


@query("SELECT lower(trim(n)) AS domain, min(id) AS id FROM (SELECT o_orderkey AS id, ' Site' || CAST(o_custkey % 90 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END AS n FROM orders) GROUP BY 1")
def site_cache(spark, d):
    return ingest.site_cache(base(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit(" Site"), (F.col("o_custkey") % 90).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("")).alias("domain")))


@query("""WITH dup AS (SELECT id, duplicate_of_page_id AS real FROM v_page WHERE duplicate_of_page_id IS NOT NULL), new AS (SELECT from_page % 250 AS f, to_page % 250 AS t FROM v_link)
SELECT from_page, to_page FROM (SELECT from_page, to_page FROM v_link UNION SELECT coalesce(real, f), t FROM new LEFT JOIN dup ON dup.id = f WHERE coalesce(real, f) <> t)""")
def links_after_ingest(spark, d):
    links = view(spark, d, "v_link")
    return ingest.add_links(links, links.select((F.col("from_page") % 250).alias("from_page"), (F.col("to_page") % 250).alias("to_page")), view(spark, d, "v_page"))


@query("SELECT DISTINCT f.source_url, f.url, p.url IS NOT NULL AS known FROM v_found f LEFT JOIN (SELECT DISTINCT url FROM v_found WHERE ord % 3 = 0) p ON p.url = f.url WHERE f.url <> f.source_url")
def discovered_links(spark, d):
    found = view(spark, d, "v_found")
    return ingest.discovered(found.select("source_url", F.concat("url", F.lit("#top")).alias("url")), found.where("ord % 3 = 0").select("url"))


@query("""SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.t, b.t) AS data_type_code, coalesce(b.data, a.data) AS data FROM
 (SELECT p_partkey AS page_id, 'PDF' AS t, 'old' AS data FROM part WHERE p_partkey % 2 = 0) a FULL JOIN (SELECT p_partkey AS page_id, CASE WHEN p_partkey % 5 = 0 THEN 'DOC' ELSE 'PDF' END AS t, CASE WHEN p_partkey % 7 <> 0 THEN 'new' END AS data FROM part WHERE p_partkey % 3 = 0) b ON a.page_id = b.page_id AND a.t = b.t""")
def page_data_upsert(spark, d):
    rows = base(spark, d, "part").select(F.col("p_partkey").alias("page_id"))
    old = rows.where("page_id % 2 = 0").select("page_id", F.lit("PDF").alias("data_type_code"), F.lit("old").alias("data"))
    new = rows.where("page_id % 3 = 0").select("page_id", F.when(F.col("page_id") % 5 == 0, "DOC").otherwise("PDF").alias("data_type_code"), F.when(F.col("page_id") % 7 != 0, "new").alias("data"))
    return ingest.upsert_page_data(old, new.unionByName(new))


def _image_tables(spark, d) -> dict[str, DataFrame]:
    found = view(spark, d, "v_found")
    pages = found.where("ord % 2 = 0").groupBy("url").agg(F.min("ord").alias("id")).select("id", "url", F.when(F.col("id") % 4 == 0, "FRONTIER").otherwise("HTML").alias("page_type_code"))
    images = found.where("ord % 10 = 3").select((F.col("ord") % 50).alias("page_id"), F.col("url").alias("filename"), F.lit(None).cast("string").alias("content_type"), now().alias("accessed_time")).distinct()
    shown = found.where("ord % 5 = 3").select((F.col("ord") % 50).alias("page_id"), F.concat("url", F.lit(".png#a")).alias("url")).union(found.where("ord % 5 = 3").select((F.col("ord") % 50).alias("page_id"), "url"))
    return ingest.discovered_images(pages, found.where("ord < 0").select(F.col("ord").alias("from_page"), F.col("ord").alias("to_page")), images, shown, now())


_IMG = """pg AS (SELECT url, min(ord) AS id FROM v_found WHERE ord % 2 = 0 GROUP BY url), fo AS (SELECT DISTINCT ord % 50 AS page_id, url || x AS url FROM v_found, (VALUES (''), ('.png')) v(x) WHERE ord % 5 = 3),
 nw AS (SELECT (SELECT max(id) FROM pg) + row_number() OVER (ORDER BY url) AS id, url FROM (SELECT DISTINCT url FROM fo WHERE url NOT IN (SELECT url FROM pg))),
 ev AS (SELECT id, url, CASE WHEN id % 4 = 0 AND url NOT IN (SELECT url FROM fo) THEN 'FRONTIER' WHEN id % 4 = 0 THEN 'BINARY' ELSE 'HTML' END AS t FROM pg UNION ALL SELECT id, url, 'BINARY' FROM nw)"""


@query(f"WITH {_IMG} SELECT id, url, t AS page_type_code FROM ev")
def image_pages(spark, d):
    return _image_tables(spark, d)["pages"]


@query(f"WITH {_IMG} SELECT DISTINCT page_id AS from_page, id AS to_page FROM fo JOIN ev USING (url) WHERE page_id <> id")
def image_links(spark, d):
    return _image_tables(spark, d)["links"]


@query(f"WITH {_IMG} SELECT page_id, url AS filename, CASE WHEN url LIKE '%.png' THEN 'image/png' END AS content_type FROM fo UNION SELECT DISTINCT ord % 50, url, NULL FROM v_found WHERE ord % 10 = 3")
def image_records(spark, d):
    return _image_tables(spark, d)["images"].select("page_id", "filename", "content_type")


@query("SELECT url, max(0) AS priority, min(1) AS depth, arg_min(source_url, ord) AS source_url FROM v_found GROUP BY url")
def ingest_queue(spark, d):
    return frontier.merge_batch(ingest.ingest_candidates(view(spark, d, "v_found").select("source_url", "url", "ord"), now())).select("url", "priority", "depth", "source_url")


@query("""WITH s AS (SELECT client_id AS id, min(source) AS robots_content, min(city) || chr(10) || min(segment) AS sitemap_content FROM clients WHERE client_id IS NOT NULL GROUP BY client_id),
 c AS (SELECT client_id AS id, arg_max(source, (seq, change_id)) AS r, list(city ORDER BY seq, change_id) AS l FROM client_changes WHERE client_id IS NOT NULL AND seq IS NOT NULL GROUP BY client_id),
 n AS (SELECT s.*, c.r, list_filter(c.l, lambda x, i: x IS NOT NULL AND trim(x) <> '' AND list_position(c.l, x) = i) AS u FROM s LEFT JOIN c USING (id))
SELECT id, coalesce(CASE WHEN trim(coalesce(r, '')) <> '' THEN r END, robots_content) AS robots_content, coalesce(CASE WHEN len(u) > 0 THEN array_to_string(u, chr(10)) END, sitemap_content) AS sitemap_content, CASE WHEN len(u) > 0 AND array_to_string(u, chr(10)) IS DISTINCT FROM sitemap_content THEN CAST(len(u) AS INT) ELSE 0 END AS n_new FROM n""")
def site_policy_update(spark, d):
    """Clients' stored texts after what their changes say: the last source, and the cities in their order."""
    sites = base(spark, d, "clients").where("client_id IS NOT NULL").groupBy(F.col("client_id").alias("id")).agg(F.min("source").alias("robots_content"), F.concat(F.min("city"), F.lit("\n"), F.min("segment")).alias("sitemap_content"))
    changes = base(spark, d, "client_changes").where("client_id IS NOT NULL AND seq IS NOT NULL")
    cities = F.transform(F.array_sort(F.collect_list(F.struct("seq", "change_id", "city"))), lambda x: x["city"])
    came = changes.groupBy(F.col("client_id").alias("id")).agg(F.max_by("source", F.struct("seq", F.col("change_id"))).alias("robots_content"), cities.alias("robots_sitemaps"))
    return ingest.update_site_policy(sites, came).select("id", "robots_content", "sitemap_content", F.size("new_sitemaps").alias("n_new"))


@query("""WITH s AS (SELECT 'k' || CAST(o_custkey % 100 AS VARCHAR) AS key, CAST(o_orderkey AS VARCHAR) AS value, o_orderdate AS t FROM orders)
SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC, value DESC) AS r FROM s) WHERE r = 1""")
def settings_upsert(spark, d):
    rows = base(spark, d, "orders").select(F.concat(F.lit("k"), (F.col("o_custkey") % 100).cast("string")).alias("key"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderdate").alias("updated_at"), F.lit("u").alias("updated_by"))
    return ingest.upsert_setting(rows.limit(0), rows).select("key", "value")


@query("SELECT url, min(ord) AS ord FROM v_found WHERE ord % 2 = 0 GROUP BY url UNION ALL SELECT url, min(ord) FROM v_found WHERE ord % 2 = 1 AND url NOT IN (SELECT url FROM v_found WHERE ord % 2 = 0) GROUP BY url")
def seeds_added(spark, d):
    found = view(spark, d, "v_found").select("url", "ord")
    old = found.where("ord % 2 = 0").groupBy("url").agg(F.min("ord").alias("ord"))
    return ingest.add_seeds(old, found.where("ord % 2 = 1"), ["url"])


# --- events, commands, workers ------------------------------------------------------------------------------------------

def _events(spark, d) -> DataFrame:
    return view(spark, d, "v_event")


@query("""SELECT id, CASE WHEN id % 10 = 0 THEN 'info' ELSE event_type END AS type, CASE WHEN id % 7 = 0 THEN 'local-default' ELSE 'd' || CAST(id % 3 AS VARCHAR) END AS daemon FROM (SELECT event_id AS id, event_type FROM events)""")
def event_envelopes(spark, d):
    rows = base(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, " ").otherwise(F.col("event_type")).alias("type"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string"))).alias("daemonId"), F.col("user_id").cast("int").alias("workerId"), F.col("event_id").cast("string").alias("payload"), "ts")
    return ev.envelopes(rows).select(F.col("payload").cast("long").alias("id"), "type", F.col("daemonId").alias("daemon"))


_J = "json_extract_string(payload, '$.{}')"
_MESSAGE = "coalesce(json_extract_string(payload, '$.message'), nullif(concat_ws(' | ', 'status=' || json_extract_string(payload, '$.status'), 'previousStatus=' || json_extract_string(payload, '$.previousStatus'), 'action=' || json_extract_string(payload, '$.action'), 'url=' || json_extract_string(payload, '$.url'), 'priority=' || json_extract_string(payload, '$.priority')), ''), type)"
_LEVEL = f"CASE WHEN type = 'error' OR contains(lower({_MESSAGE}), 'failed') OR contains(lower({_MESSAGE}), 'error') THEN 'Error' WHEN type = 'frontier-prune' THEN 'Warning' ELSE coalesce(json_extract_string(payload, '$.level'), 'Info') END"
_LOGGED = "type IN ('error', 'status-change', 'queue-change', 'frontier-prune', 'page-reported')"


@query(f"SELECT id, {_MESSAGE} AS message, coalesce(json_extract_string(payload, '$.level'), CASE WHEN contains(type, 'error') OR contains(type, 'failed') THEN 'Error' WHEN contains(type, 'warn') THEN 'Warning' ELSE 'Info' END) AS level FROM v_event")
def event_messages(spark, d):
    return _events(spark, d).select("id", telemetry.message(F.col("type"), F.col("payload")).alias("message"), telemetry.level(F.col("type"), F.col("payload")).alias("level"))


def _logs(spark, d) -> DataFrame:
    # dealt out, as payloads take long to read and a file's few row groups would be as few tasks
    rows = _events(spark, d).where(F.col("type").isin(telemetry.LOGGED_TYPES)).repartition("id").withColumn("__log", telemetry.logged(F.col("type"), F.col("payload")))
    return rows.select("id", "__log.level", "__log.message", F.col("worker_id").alias("external_worker_id"), F.col("ts").alias("created_at"))


@query(f"SELECT id, {_LEVEL} AS level, {_MESSAGE} AS message FROM v_event WHERE {_LOGGED}")
def event_logs(spark, d):
    return _logs(spark, d).select("id", "level", "message")


@query(f"SELECT id, level FROM (SELECT id, ts, {_LEVEL} AS level, {_MESSAGE} AS message FROM v_event WHERE {_LOGGED}) WHERE lower(level) = 'error' AND message ILIKE '%for 1%' ORDER BY ts DESC, id DESC LIMIT 100")
def live_log_search(spark, d):
    return activity.search_logs(_logs(spark, d), None, "error", "for 1", 100).select("id", "level")


@query("SELECT id, CASE WHEN type = 'page-reported' THEN CAST(1 AS DOUBLE) END AS pages, CAST(json_extract_string(payload, '$.priority') AS INT) AS priority FROM (SELECT *, type AS t FROM v_event)")
def event_numbers(spark, d):
    typed = F.when(F.col("type") == "page-reported", F.regexp_replace("payload", r"^\{", '{"type":"page-reported",')).otherwise(F.col("payload"))
    return _events(spark, d).select("id", telemetry.metric_increment(typed).alias("pages"), telemetry.queue_numbers(F.col("payload"))["priority"].alias("priority"))


@query("""SELECT worker_id, arg_max(lower(status), (ts, id)) FILTER (status IS NOT NULL) AS status, arg_max(url, (ts, id)) FILTER (url IS NOT NULL) AS current_url, max(ts) AS last_heartbeat_at
 FROM (SELECT worker_id, ts, id, json_extract_string(payload, '$.status') AS status, json_extract_string(payload, '$.url') AS url FROM v_event) GROUP BY worker_id""")
def worker_latest_state(spark, d):
    rows = _events(spark, d).select("worker_id", "ts", "id", F.lower(telemetry.field(F.col("payload"), "status")).alias("status"), telemetry.field(F.col("payload"), "url").alias("current_url"), F.lit(None).cast("long").alias("pages_processed"), F.lit(None).cast("long").alias("error_count"))
    return activity.latest_state(rows).select("worker_id", "status", "current_url", "last_heartbeat_at")


_STATE = "s AS (SELECT id, ts, worker_id, upper(json_extract_string(payload, '$.status')) AS state FROM v_event WHERE type = 'status-change'), l AS (SELECT *, lag(state) OVER (PARTITION BY worker_id ORDER BY ts, id) AS previous FROM s)"


@query(f"WITH {_STATE} SELECT id, previous, state FROM l WHERE previous <> state AND (previous, state) NOT IN (('IDLE', 'ACTIVE'), ('ACTIVE', 'IDLE'), ('IDLE', 'STOPPED'), ('ACTIVE', 'STOPPED'), ('ACTIVE', 'PAUSED'), ('PAUSED', 'ACTIVE'), ('PAUSED', 'STOPPED'), ('STOPPED', 'IDLE'))")
def illegal_transitions(spark, d):
    rows = _events(spark, d).where("type = 'status-change'").select("id", "ts", "worker_id", telemetry.field(F.col("payload"), "status").alias("state"))
    return activity.illegal_transitions(rows, "worker_id", "state").select("id", "previous", "state")


@query("SELECT id, row_number() OVER (ORDER BY ts, id) AS ord FROM v_event WHERE type IN ('page-reported', 'queue-change')")
def replay_order(spark, d):
    return activity.ordered_events(_events(spark, d), ["page-reported", "queue-change"]).select("id", "ord")


@query("SELECT id, type FROM v_event WHERE type LIKE 'frontier%' OR type = 'queue-change' ORDER BY ts DESC, id DESC LIMIT 20")
def arbitration_events(spark, d):
    return activity.arbitration_events(_events(spark, d)).select("id", "type")


@query("SELECT worker_id, id, type FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY ts DESC, id DESC) AS r FROM v_event) WHERE r = 1")
def latest_snapshots(spark, d):
    return activity.latest_snapshot(_events(spark, d).select("worker_id", "ts", "id", "type"), "worker_id").select("worker_id", "id", "type")


@query("SELECT c.id, coalesce(json_extract_string(d.metadata, '$.daemonId'), 'local-default') AS daemon FROM v_command c JOIN v_daemon d ON d.id = c.id % 25")
def command_daemons(spark, d):
    commands = view(spark, d, "v_command").withColumn("daemon_id", F.col("id") % 25)
    return activity.with_daemon(commands, view(spark, d, "v_daemon")).select("id", "daemon")


@query("SELECT id, CASE WHEN r <= 100 AND status = 'queued' THEN 'dispatched' ELSE status END AS status FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY created_at, id) AS r FROM v_command)")
def command_dispatch(spark, d):
    rows = view(spark, d, "v_command").withColumn("dispatched_at", F.lit(None).cast("timestamp_ntz"))
    return activity.dispatch(rows, now()).select("id", "status")


@query(f"""SELECT id, CASE id % 6 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE status END AS status, CASE id % 6 WHEN 2 THEN 'broken' WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE error_message END AS error_message,
 CASE WHEN id % 6 = 0 THEN {TS} END AS acknowledged_at, CASE WHEN id % 6 IN (1, 2) THEN {TS} ELSE completed_at END AS completed_at FROM v_command""")
def command_answers(spark, d):
    rows = view(spark, d, "v_command").withColumn("acknowledged_at", F.lit(None).cast("timestamp_ntz")).withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz"))
    acks = rows.where("id % 6 < 3").select("id", F.lit("ack").alias("kind"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    results = rows.where("id % 6 in (1, 2)").select("id", F.lit("result").alias("kind"), (F.col("id") % 6 == 1).alias("ok"), F.when(F.col("id") % 6 == 2, "broken").alias("error"))
    return activity.answered(rows, acks.union(results), now()).select("id", "status", "error_message", "acknowledged_at", "completed_at")


@query("""SELECT c.id, coalesce(json_extract_string(d.metadata, '$.daemonId'), 'local-default') AS daemon, '[command-dispatch] commandId=' || CAST(c.id AS VARCHAR) || ' type=' || command_type || ' status=queued reason=in-flight-timeout' AS message
 FROM (SELECT * FROM v_command WHERE status IN ('dispatched', 'acknowledged') AND completed_at IS NULL AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 45 SECOND ORDER BY created_at, id LIMIT 100) c JOIN v_daemon d ON d.id = c.id % 25""")
def stale_command_logs(spark, d):
    rows = view(spark, d, "v_command").withColumn("dispatched_at", F.col("created_at")).withColumn("daemon_id", F.col("id") % 25)
    return activity.stale_logs(rows, view(spark, d, "v_daemon"), F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")).select("id", "daemon", "message")


@query("""WITH a AS (SELECT 'd' || CAST(n_nationkey AS VARCHAR) AS identifier FROM nation UNION ALL SELECT 'NODE ' || CAST(n_nationkey AS VARCHAR) FROM nation)
SELECT identifier, coalesce((SELECT min(id) FROM v_daemon WHERE json_extract_string(metadata, '$.daemonId') = identifier), (SELECT min(id) FROM v_daemon WHERE lower(name) = lower(identifier))) AS daemon_id FROM a
 WHERE identifier IN (SELECT json_extract_string(metadata, '$.daemonId') FROM v_daemon WHERE id % 3 = 0) OR lower(identifier) IN (SELECT lower(name) FROM v_daemon)""")
def daemon_resolution(spark, d):
    nation = base(spark, d, "nation")
    asked = nation.select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("identifier")).union(nation.select(F.concat(F.lit("NODE "), F.col("n_nationkey").cast("string"))))
    return activity.resolve_daemon(asked, view(spark, d, "v_daemon"))


@query("""SELECT w.worker_id, n.id AS node_id FROM v_worker w JOIN v_daemon d ON d.id = w.daemon_id LEFT JOIN (SELECT url, min(id) AS id FROM v_frontier GROUP BY url) n ON n.url = w.current_url
 WHERE lower(w.status) = 'active' AND lower(coalesce(d.status, '')) NOT IN ('offline', 'stopped', '')""")
def active_workers(spark, d):
    return activity.active_workers(view(spark, d, "v_worker"), view(spark, d, "v_daemon"), view(spark, d, "v_frontier").select("id", "url")).select("worker_id", "node_id")


@query("SELECT worker_id FROM v_worker WHERE lower(status) = 'idle' AND (contains(lower(name), '5') OR contains(lower(current_url), '5')) ORDER BY name")
def worker_list(spark, d):
    return activity.filtered_workers(view(spark, d, "v_worker"), "Idle", " 5 ").select("worker_id")


@query("SELECT worker_id, CASE WHEN pages_processed + error_count > 0 THEN round(pages_processed * 100.0 / (pages_processed + error_count), 6) ELSE 100.0 END AS rate FROM v_worker")
def worker_success_rates(spark, d):
    return view(spark, d, "v_worker").select("worker_id", F.round(telemetry.success_rate(F.col("pages_processed"), F.col("error_count")), 6).alias("rate"))


@query("""SELECT worker_id, CASE WHEN s = 'paused' THEN 'Paused' WHEN s = 'stopped' THEN 'Stopped' WHEN s = 'active' AND current_url IS NOT NULL THEN 'Crawling' WHEN worker_id % 5 = 0 THEN 'Waiting for URLs' WHEN s = 'active' THEN 'Working' ELSE 'Idle' END AS activity,
 upper(s[1]) || s[2:] AS label FROM (SELECT *, lower(status) AS s FROM v_worker)""")
def worker_activity(spark, d):
    reason = F.when(F.col("worker_id") % 5 == 0, "queue is empty")
    return view(spark, d, "v_worker").select("worker_id", telemetry.activity(F.col("status"), reason, F.col("current_url")).alias("activity"), telemetry.capitalised(F.col("status")).alias("label"))


def _groups(spark, d) -> DataFrame:
    rows = view(spark, d, "v_worker").groupBy((F.col("worker_id") % 6).alias("ord")).agg(F.array_sort(F.collect_list(F.col("worker_id"))).alias("worker_ids"))
    lower = view(spark, d, "v_worker").where("worker_id < 9").agg(F.lit(100).cast("long").alias("ord"), F.array_sort(F.collect_list("worker_id")).alias("worker_ids"))
    return rows.where("ord <> 2").union(lower).withColumn("name", F.concat(F.lit("g"), F.col("ord").cast("string")))


@query("SELECT worker_id, CASE WHEN worker_id % 6 <> 2 THEN 'g' || CAST(worker_id % 6 AS VARCHAR) WHEN worker_id < 9 THEN 'g100' END AS group_name FROM v_worker")
def worker_groups(spark, d):
    return activity.group_of(view(spark, d, "v_worker"), _groups(spark, d)).select("worker_id", "group_name")


@query("SELECT 'g' || CAST(worker_id % 6 AS VARCHAR) AS name, count(*) FILTER (lower(status) = 'active') AS n FROM v_worker WHERE worker_id % 6 <> 2 GROUP BY worker_id % 6 UNION ALL SELECT 'g100', count(*) FILTER (lower(status) = 'active' AND worker_id < 9) FROM v_worker")
def group_sizes(spark, d):
    return activity.group_sizes(_groups(spark, d), view(spark, d, "v_worker").where("lower(status) = 'active'"))


@query("SELECT daemon_id, array_to_string(list_sort(list(worker_id)), ',') AS worker_ids FROM v_worker WHERE worker_id % 6 = 2 GROUP BY daemon_id")
def ungrouped_workers(spark, d):
    keyed = view(spark, d, "v_worker").where("worker_id % 6 <> 2").groupBy((F.col("worker_id") % 6).alias("g")).agg(F.collect_list(F.concat_ws(":", "daemon_id", "worker_id")).alias("worker_keys"))
    return activity.ungrouped(view(spark, d, "v_worker"), keyed).select("daemon_id", F.array_join("worker_ids", ",").alias("worker_ids"))


@query("""WITH t AS (SELECT 'ip' || CAST(s_suppkey AS VARCHAR) AS ip_key, CAST(s_suppkey AS DOUBLE) AS remaining, 'h' || CAST(s_suppkey % 15 AS VARCHAR) || '.example.org' AS dom FROM supplier),
 b AS (SELECT dom AS host, min(ip_key) AS ip_key FROM t GROUP BY dom) SELECT f.id, b.ip_key, t.remaining FROM v_frontier f LEFT JOIN b ON b.host = f.site_key LEFT JOIN t ON t.ip_key = b.ip_key""")
def queue_timeouts(spark, d):
    k = F.col("s_suppkey")
    timeouts = base(spark, d, "supplier").select(F.concat(F.lit("ip"), k.cast("string")).alias("ip_key"), (k * 1.0).cast("double").alias("remaining"), F.array(F.concat(F.lit("H"), (k % 15).cast("string"), F.lit(".example.org"))).alias("domains"))
    return activity.queue_timeouts(view(spark, d, "v_frontier").select("id", F.col("site_key").alias("host")), timeouts).select("id", "ip_key", "remaining")


@query("""SELECT f.ord, CASE WHEN c.w = f.ord % 5 THEN 'completed' WHEN c.w IS NOT NULL THEN 'conflict' ELSE 'pending' END AS outcome FROM v_found f LEFT JOIN (SELECT CAST(ord AS VARCHAR) AS url, min(ord % 4) AS w FROM v_found WHERE ord % 3 = 0 GROUP BY ord) c ON c.url = CAST(f.ord AS VARCHAR)""")
def seed_arbitration(spark, d):
    rows = view(spark, d, "v_found").select(F.col("ord").cast("string").alias("url"), "ord")
    out = activity.arbitration(rows.select("url", (F.col("ord") % 5).alias("worker_id")), rows.where("ord % 3 = 0").select("url", (F.col("ord") % 4).alias("worker_id")))
    return out.select(F.col("url").cast("long").alias("ord"), "outcome")


_FNV = "list_reduce(list_prepend({basis}::HUGEINT, list_transform(string_split({text}, ''), lambda c: ord(c)::HUGEINT)), lambda h, u: (xor(h, u) * {prime}::HUGEINT) % {modulus}::HUGEINT)"
_WIDE = "18446744073709551616"


def _fnv(text: str, basis: int, prime: int = hashing.PRIME64, modulus: str = _WIDE) -> str:
    return _FNV.format(basis=basis, text=text, prime=prime, modulus=modulus)


def _few_workers(spark, d) -> DataFrame:
    return base(spark, d, "nation").select(F.col("n_nationkey").alias("worker_id"))


@query(f"""WITH h AS (SELECT id, n_nationkey AS w, {_fnv("url || '|' || CAST(n_nationkey AS VARCHAR)", hashing.SCORE_BASIS)} AS u FROM v_page, nation),
 s AS (SELECT id, w, CAST(CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - {_WIDE}::HUGEINT ELSE u END AS DOUBLE) AS score FROM h)
SELECT id, CAST(w AS BIGINT) AS worker_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, w) AS r FROM s) WHERE r = 1""")
def rendezvous_assignment(spark, d):
    pages = view(spark, d, "v_page").select("id", "url")
    return activity.assign_seeds(pages, _few_workers(spark, d)).join(pages, "url").select("id", "worker_id")


@query(f"SELECT id, CAST({_fnv('url', hashing.SLOT_BASIS)} % 25::HUGEINT AS BIGINT) AS worker_id FROM v_page")
def round_robin_assignment(spark, d):
    pages = view(spark, d, "v_page").select("id", "url")
    return activity.assign_seeds(pages.select("url").distinct(), _few_workers(spark, d), "round_robin").join(pages, "url").select("id", F.col("worker_id").cast("long").alias("worker_id"))


@query(f"SELECT id, CAST({_fnv('url', hashing.BASIS32, hashing.PRIME32, '4294967296')} AS DOUBLE) / 4294967296 AS unit FROM v_page")
def unit_hashes(spark, d):
    return view(spark, d, "v_page").select("id", hashing.unit_hash(F.col("url")).alias("unit"))


@query("""WITH b AS (SELECT time_bucket(INTERVAL 600 SECOND, created_at, TIMESTAMP '2001-01-01') AS bucket, sum(metric_value) AS value FROM v_metric WHERE metric_name = 'page_processed' GROUP BY 1)
SELECT min(bucket) AS first, max(bucket) AS last, round(greatest(1.0, max(value)), 6) AS most, round(sum(value), 6) AS total FROM b""")
def series_extents(spark, d):
    rows = view(spark, d, "v_metric").where("metric_name = 'page_processed'").groupBy(activity.bucket(F.col("created_at").cast("timestamp"), 600).alias("bucket")).agg(F.sum("metric_value").alias("value"))
    out = activity.series_extents(rows)
    return out.select(F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), F.round("most", 6).alias("most"), F.round("total", 6).alias("total"))


# --- graph and page views -----------------------------------------------------------------------------------------------

def _nodes(spark, d) -> DataFrame:
    return view(spark, d, "v_page").select("id", "url", "domain", (F.col("id") % 23).cast("int").alias("size"), F.round(scoring.graph_score(F.col("url"), F.col("domain")), 6).alias("score"), (F.col("id") % 9 == 0).alias("queued"), (F.col("id") % 4 == 0).alias("in_view"))


def _edges(spark, d) -> DataFrame:
    return view(spark, d, "v_link").select((F.col("from_page") % 250).alias("from_page"), (F.col("to_page") % 250).alias("to_page")).where("from_page <> to_page").distinct()


_NODES = f"n AS (SELECT id, url, domain, CAST(id % 23 AS INT) AS size, round(least(1.0, {_GRAPH}), 6) AS score FROM v_page), ed AS (SELECT DISTINCT from_page % 250 AS from_page, to_page % 250 AS to_page FROM v_link WHERE from_page % 250 <> to_page % 250)"


@query("SELECT id FROM v_page ORDER BY id DESC LIMIT 50")
def newest_nodes(spark, d):
    return graph.newest_nodes(view(spark, d, "v_page"), 50).select("id")


@query(f"WITH {_NODES} SELECT id, size FROM n ORDER BY size DESC, id LIMIT 12")
def replay_seeds(spark, d):
    return graph.replay_seeds(_nodes(spark, d)).select("id", "size")


@query(f"WITH {_NODES}, h AS (SELECT * FROM n WHERE contains(lower(url), 'blog') OR contains(lower(domain), 'blog') ORDER BY size DESC, id LIMIT 8) SELECT id FROM h")
def seed_nodes(spark, d):
    return graph.seed_nodes(_nodes(spark, d), ["BLOG"], 250).select("id")


@query(f"WITH {_NODES} SELECT id FROM n ORDER BY size DESC, id LIMIT 8")
def seed_nodes_by_size(spark, d):
    return graph.seed_nodes(_nodes(spark, d), ["no such word"], 250).select("id")


@query(f"WITH {_NODES} SELECT id FROM n WHERE id % 9 = 0 ORDER BY score + size * 0.05 DESC, id LIMIT 30")
def frontier_candidates(spark, d):
    return graph.frontier_candidates(_nodes(spark, d), 30).select("id")


@query(f"WITH {_NODES} SELECT id FROM n ORDER BY (id % 4 = 0) DESC, size DESC, id LIMIT 100")
def visible_nodes(spark, d):
    return graph.visible_subset(_nodes(spark, d), _edges(spark, d), 100)[0].select("id")


@query(f"WITH {_NODES}, s AS (SELECT id FROM n ORDER BY (id % 4 = 0) DESC, size DESC, id LIMIT 100) SELECT from_page, to_page FROM ed WHERE from_page IN (SELECT id FROM s) AND to_page IN (SELECT id FROM s)")
def visible_links(spark, d):
    return graph.visible_subset(_nodes(spark, d), _edges(spark, d), 100)[1]


@query("SELECT id FROM v_page WHERE contains(lower(url), 'blog') OR contains(lower(domain), 'blog') ORDER BY id LIMIT 1")
def focused_node(spark, d):
    return graph.focused_node(_nodes(spark, d), "Blog").select("id")


_SITES = f"t AS (SELECT domain, count(*) AS n_pages, round(avg(s), 6) AS average FROM (SELECT domain, least(1.0, {_GRAPH}) AS s FROM v_page) GROUP BY domain), x AS (SELECT sqrt(least(1, min(n_pages))) AS p0, sqrt(greatest(1, max(n_pages))) AS p1, least(0.0, min(average)) AS s0, greatest(1.0, max(average)) AS s1 FROM t)"


@query(f"WITH {_SITES} SELECT domain, round(CASE WHEN p0 = p1 THEN 28.0 ELSE 12 + 32 * (sqrt(n_pages) - p0) / (p1 - p0) END, 6) AS radius, round((average - s0) / (s1 - s0), 6) AS shade FROM t, x")
def node_scales(spark, d):
    return graph.scaled_nodes(graph.site_nodes(view(spark, d, "v_page"))).select("domain", "radius", "shade")


@query("WITH g AS (SELECT least(from_site, to_site) AS a, greatest(from_site, to_site) AS b, count(*) AS w FROM v_link WHERE from_site <> to_site GROUP BY 1, 2) SELECT a, b, round(1.2 + 4.2 * (sqrt(w) - 1) / (sqrt((SELECT max(w) FROM g)) - 1), 6) AS width FROM g")
def edge_scales(spark, d):
    return graph.scaled_edges(graph.site_edges(view(spark, d, "v_link")).withColumnRenamed("n", "weight")).select(F.col("site_a").alias("a"), F.col("site_b").alias("b"), "width")


_KEY = "CASE WHEN len(p) <= 2 THEN array_to_string(p, '.') WHEN length(p[-1]) = 2 AND length(p[-2]) <= 3 THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END"


@query(f"SELECT id, 'domain:' || {_KEY} AS by_domain, 'subdomain:' || domain AS by_host FROM (SELECT id, domain, string_split(domain, '.') AS p FROM v_page)")
def group_keys(spark, d):
    return view(spark, d, "v_page").select("id", graph.group_key(F.col("url"), F.col("domain"), "domain").alias("by_domain"), graph.group_key(F.lit(None).cast("string"), F.col("domain"), "subdomain").alias("by_host"))


_ROLL = f"{_NODES}, k AS (SELECT *, domain AS key, id % 9 = 0 AS queued FROM n), top AS (SELECT key, count(*) AS n, count(*) FILTER (queued) AS n_queued, round(avg(score), 6) AS score FROM k GROUP BY key ORDER BY n DESC, key LIMIT 6)"


@query(f"WITH {_ROLL} SELECT key, n, n_queued, score FROM top")
def roll_up_groups(spark, d):
    return graph.roll_up(_nodes(spark, d), _edges(spark, d), F.col("domain"), 6, 40)[0]


@query(f"""WITH {_ROLL}, pr AS (SELECT least(x.key, y.key) AS a, greatest(x.key, y.key) AS b FROM ed JOIN k x ON x.id = from_page JOIN k y ON y.id = to_page WHERE x.key <> y.key)
SELECT a, b, count(*) AS weight FROM pr WHERE a IN (SELECT key FROM top) AND b IN (SELECT key FROM top) GROUP BY a, b ORDER BY weight DESC, a, b LIMIT 40""")
def roll_up_edges(spark, d):
    return graph.roll_up(_nodes(spark, d), _edges(spark, d), F.col("domain"), 6, 40)[1]


@query("""WITH f AS (SELECT worker_id AS page, min((ts, id)) AS seen FROM v_event GROUP BY worker_id) SELECT page, row_number() OVER (ORDER BY seen) AS frame FROM f""")
def replay_frames(spark, d):
    return graph.replay_frames(_events(spark, d).select(F.col("worker_id").alias("page"), "ts", "id"), _edges(spark, d))[0]


@query("""WITH f AS (SELECT worker_id AS page, min((ts, id)) AS seen FROM v_event GROUP BY worker_id), r AS (SELECT page, row_number() OVER (ORDER BY seen) AS frame FROM f), ed AS (SELECT DISTINCT from_page % 250 AS from_page, to_page % 250 AS to_page FROM v_link WHERE from_page % 250 <> to_page % 250)
SELECT from_page, to_page, greatest(x.frame, y.frame) AS frame FROM ed JOIN r x ON x.page = from_page JOIN r y ON y.page = to_page""")
def replay_links(spark, d):
    return graph.replay_frames(_events(spark, d).select(F.col("worker_id").alias("page"), "ts", "id"), _edges(spark, d))[1]


@query("""WITH e AS (SELECT from_page AS a, to_page AS b FROM v_link UNION SELECT to_page, from_page FROM v_link), s AS (SELECT min(from_page) AS p FROM v_link), d1 AS (SELECT DISTINCT b AS page FROM e, s WHERE a = p AND b <> p),
 d2 AS (SELECT DISTINCT b AS page FROM e, s WHERE a IN (SELECT page FROM d1) AND b <> p AND b NOT IN (SELECT page FROM d1)) SELECT p AS page, 0 AS distance FROM s UNION ALL SELECT page, 1 FROM d1 UNION ALL SELECT page, 2 FROM d2""")
def page_neighbourhood(spark, d):
    links = checkpointed(view(spark, d, "v_link").select("from_page", "to_page"))
    return graph.neighbourhood(links, links.agg(F.min("from_page")).first()[0], 2)


@query(f"""WITH {_NODES}, o AS (SELECT from_page, to_page, row_number() OVER (ORDER BY greatest(from_page, to_page) DESC, from_page, to_page) AS ord FROM ed WHERE from_page IN (SELECT id FROM n) AND to_page IN (SELECT id FROM n)), l AS (SELECT * FROM o WHERE ord <= 2000),
 m AS (SELECT page, min(k) AS k FROM (SELECT from_page AS page, 2 * ord AS k FROM l UNION ALL SELECT to_page, 2 * ord + 1 FROM l) GROUP BY page ORDER BY k LIMIT 60),
 kept AS (SELECT from_page, to_page FROM l WHERE from_page IN (SELECT page FROM m) AND to_page IN (SELECT page FROM m)), ids AS (SELECT from_page AS id FROM kept UNION SELECT to_page FROM kept)
SELECT n.id, coalesce(c.n, 1) AS size, n.score FROM n JOIN ids USING (id) LEFT JOIN (SELECT to_page, count(*) AS n FROM ed GROUP BY to_page) c ON c.to_page = n.id""")
def page_graph_nodes(spark, d):
    return graph.page_graph(view(spark, d, "v_page"), _edges(spark, d), 60)[0].select("id", "size", "score")


@query("""WITH u AS (SELECT id, lower(url) AS a, lower(regexp_replace(url, '\\?.*$', '')) AS b FROM v_page), k AS (SELECT id, a AS key FROM u UNION SELECT id, b FROM u UNION SELECT id, regexp_replace(b, '/$', '') FROM u) SELECT key, min(id) AS id FROM k GROUP BY key""")
def url_node_index(spark, d):
    return graph.url_index(view(spark, d, "v_page").select("id", "url"), telemetry.url_variants(F.col("url")))


@query("""SELECT p.id, h.source_url, coalesce(h.depth, 0) AS depth FROM (SELECT id, url FROM v_frontier) p LEFT JOIN
 (SELECT url, arg_max(src, (discovered_at, id)) AS source_url, arg_max(depth, (discovered_at, id)) AS depth FROM (SELECT *, 'https://s' || CAST(id % 5 AS VARCHAR) AS src FROM v_frontier WHERE id % 3 = 0) GROUP BY url) h ON h.url = p.url""")
def page_hints(spark, d):
    f = view(spark, d, "v_frontier")
    hints = f.where("id % 3 = 0").select("id", F.concat(F.lit(" "), "url").alias("url"), F.concat(F.lit("https://s"), (F.col("id") % 5).cast("string")).alias("source_url"), "depth", "discovered_at")
    return P.with_hints(f.select("id", "url"), hints).select("id", "source_url", "depth")


@query("""SELECT p.id, s.id AS site_id, coalesce(i.n, 0) AS n_images FROM v_page p LEFT JOIN v_site s ON s.domain = p.domain LEFT JOIN (SELECT l_partkey % 250 AS page_id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) i ON i.page_id = p.id""")
def page_details(spark, d):
    images = base(spark, d, "lineitem").select((F.col("l_partkey") % 250).alias("page_id"), F.col("l_orderkey").alias("id"), F.lit("f").alias("filename"), F.lit(None).cast("string").alias("content_type")).distinct()
    data = base(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 99).alias("page_id"), F.lit("PDF").alias("data_type_code"))
    out = P.details(view(spark, d, "v_page"), view(spark, d, "v_site").select(F.col("id").cast("long").alias("id"), "domain"), images, data)
    return out.select("id", F.col("site.id").alias("site_id"), F.coalesce(F.size("images"), F.lit(0)).cast("long").alias("n_images"))


@query("SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS ord, t AS type, coalesce(n, 0) AS n FROM (VALUES (1, 'HTML'), (2, 'BINARY'), (3, 'NONE')) v(k, t) LEFT JOIN (SELECT page_type_code, count(*) AS n FROM v_page GROUP BY 1) c ON c.page_type_code = t")
def zero_filled_types(spark, d):
    counts = view(spark, d, "v_page").groupBy(F.col("page_type_code").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return P.zero_filled(counts, "type", ["HTML", "BINARY", "NONE"])


@query("""WITH p AS (SELECT id, url, domain, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM v_page), r AS (SELECT domain, min(path) AS low, max(path) AS high FROM p WHERE length(path) > 4 GROUP BY domain),
 t AS (SELECT id, low, CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS x, left(low, 3) AS shut, low AS open, high AS last FROM p LEFT JOIN r USING (domain)),
 m AS (SELECT id, low IS NULL AS none, CASE WHEN starts_with(x, shut) THEN length(shut) ELSE -1 END AS d1, CASE WHEN x = last THEN length(last) + 1 ELSE -1 END AS d2, CASE WHEN starts_with(x, open) THEN length(open) + 1 ELSE -1 END AS a FROM t)
SELECT id, CASE WHEN none THEN NULL WHEN greatest(d1, d2) > a THEN false ELSE true END AS allowed, CASE WHEN none THEN 'no robots content' WHEN greatest(d1, d2, a) < 0 THEN 'no matching allow/disallow rule' WHEN greatest(d1, d2) > a THEN 'matched Disallow rule' ELSE 'matched Allow/default rule' END AS reason FROM m""")
def robots_eval(spark, d):
    """Pages against their host's rules: what begins like its smallest path is closed, that path and all below it are open, its greatest path alone is closed."""
    p = view(spark, d, "v_page").select("id", "url", "domain", U.path_of(F.col("url")).alias("path"))
    r = p.where("length(path) > 4").groupBy("domain").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    content = F.concat(F.lit("User-agent: *\nDisallow: "), F.left("low", F.lit(3)), F.lit("\nAllow: "), "low", F.lit("*\nDisallow: "), "high", F.lit("$\n\nUser-agent: other\nDisallow: /"))
    return p.join(r, "domain", "left").select("id", robots.evaluate(content, F.col("url")).alias("r")).select("id", "r.allowed", "r.reason")


@query("SELECT DISTINCT url FROM v_page WHERE domain = (SELECT min(domain) FROM v_page) ORDER BY url LIMIT 1000")
def sitemap_bfs(spark, d):
    documents, host = sitemap_documents(spark, d)
    return pipelines.sitemap_urls(documents, ["root"], host, most_documents=100)


@query("SELECT time_bucket(INTERVAL 3600 SECOND, ts, TIMESTAMP '2001-01-01') AS bucket, CAST(sum(CASE event_type WHEN 'view' THEN 1 ELSE 2 END) AS DOUBLE) AS value FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def live_throughput(spark, d):
    rows = base(spark, d, "events").select("ts", F.to_json(F.struct(F.when(F.col("event_type") == "view", F.lit("page-reported")).alias("type"), F.when(F.col("event_type") == "click", F.lit("2")).alias("page_processed"))).alias("payload"))
    return activity.live_throughput(rows, 3600).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "value")


# --- streams ------------------------------------------------------------------------------------------------------------

def _stream(spark, d, name: str) -> DataFrame:
    """A driver's table as a stream of files."""
    return spark.readStream.schema(base(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("SELECT time_bucket(INTERVAL 600 SECOND, ts, TIMESTAMP '2001-01-01') AS bucket, round(sum(value), 6) AS value FROM events WHERE event_type = 'view' GROUP BY 1")
def stream_throughput(spark, d):
    rows = _stream(spark, d, "events").select(F.when(F.col("event_type") == "view", "page_processed").otherwise(F.col("event_type")).alias("metric_name"), F.col("value").alias("metric_value"), F.col("ts").alias("created_at"))
    out = ev.run_to_end(ev.throughput(rows, 600), "complete", f"throughput_{abs(hash(d))}")
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), F.round("value", 6).alias("value"))


@query("SELECT user_id AS worker_id, arg_max(event_type, (ts, event_id)) AS status, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS pages_processed FROM events GROUP BY user_id")
def stream_worker_states(spark, d):
    rows = _stream(spark, d, "events").select(F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("current_url"), F.col("event_id").alias("pages_processed"), F.lit(None).cast("long").alias("error_count"))
    return ev.run_to_end(ev.worker_states(rows), "complete", f"states_{abs(hash(d))}").select("worker_id", "status", "pages_processed")


@query(f"SELECT worker_id, ts AS created_at, {_LEVEL} AS level, {_MESSAGE} AS message FROM v_event WHERE {_LOGGED}")
def stream_persisted_logs(spark, d):
    _stream(spark, d, "events").createOrReplaceTempView("events")
    rows = ev.envelopes(spark.sql(VIEWS["v_event"]).select("type", F.lit(None).cast("string").alias("daemonId"), F.col("worker_id").cast("int").alias("workerId"), "payload", "ts"))
    folder = f"{checkpoint_folder(spark)}/weir-stream-{uuid.uuid4().hex}"
    ev.persist(rows, f"{folder}/out", f"{folder}/state").awaitTermination()
    logs = spark.read.parquet(f"{folder}/out/worker_log")
    return logs.select(F.col("external_worker_id").cast("long").alias("worker_id"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), "level", "message")
