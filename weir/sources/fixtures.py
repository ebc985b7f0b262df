"""Crawl tables derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]

VIEWS = {
    # crawled pages (all page types, NULL type, NULL access time)
    "v_page": r"""
SELECT page_id AS id,
       regexp_replace(url, '#.*$', '') AS url,
       lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS domain,
       CASE page_id % 10 WHEN 0 THEN 'FRONTIER' WHEN 1 THEN 'BINARY' WHEN 2 THEN 'DUPLICATE'
                         WHEN 3 THEN CAST(NULL AS VARCHAR(20)) ELSE 'HTML' END AS page_type_code,
       CASE WHEN page_id % 10 = 2 THEN page_id + 2 END AS duplicate_of_page_id,
       CASE WHEN page_id % 10 = 0 THEN NULL ELSE 200 END AS http_status_code,
       CASE WHEN page_id % 10 = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-01 00:00:00' + CAST(page_id AS INT) * INTERVAL '1' MINUTE END AS accessed_time,
       html AS html_content
FROM pages
""",
    # one row per host
    "v_site": r"""
SELECT row_number() OVER (ORDER BY domain) AS id, domain
FROM (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS domain FROM pages) d
""",
    # non-trivial directed edges with the site of both ends (site = nation)
    "v_link": r"""
SELECT DISTINCT o_custkey AS from_page, 1000000 + l_suppkey AS to_page,
       c_nationkey AS from_site, s_nationkey AS to_site
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
""",
    # queue snapshot in every state
    "v_frontier": r"""
SELECT event_id AS id,
       concat('https://h', CAST(user_id % 20 AS VARCHAR(20)), '.example.org/p/', CAST(event_id AS VARCHAR(20))) AS url,
       concat('h', CAST(user_id % 20 AS VARCHAR(20)), '.example.org') AS site_key,
       CAST(floor(value / 50) AS INT) AS priority,
       CAST(event_id % 6 AS INT) AS depth,
       CASE WHEN event_id % 17 = 0 THEN 'DUPLICATE' WHEN event_type = 'signup' THEN 'QUEUED'
            WHEN event_type = 'click' THEN 'LOCKED' WHEN event_type = 'view' THEN 'PROCESSING'
            WHEN event_type = 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS state,
       ts AS discovered_at,
       CASE WHEN event_type = 'click' THEN ts + INTERVAL '1' MINUTE END AS locked_at,
       CASE WHEN event_type = 'click' THEN CAST(user_id % 8 AS INT) END AS locked_by_worker_id,
       event_id % 3 = 0 AS memory_cached
FROM events
""",
    # worker_metric rows
    "v_metric": r"""
SELECT event_id AS id, concat('daemon-', CAST(user_id % 3 AS VARCHAR(20))) AS daemon_identifier,
       user_id AS external_worker_id,
       CASE WHEN event_type = 'view' THEN 'page_processed' ELSE event_type END AS metric_name,
       value AS metric_value, props AS payload, ts AS created_at
FROM events
""",
    # worker_log rows
    "v_log": r"""
SELECT event_id AS id, user_id AS external_worker_id,
       CASE event_type WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Warning' ELSE 'Info' END AS level,
       concat('[', event_type, '] value=', CAST(event_id AS VARCHAR(20))) AS message, ts AS created_at
FROM events
""",
    # control-plane commands
    "v_command": r"""
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 4 = 0 THEN 'start-daemon' ELSE 'start-worker' END AS command_type,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'failed' WHEN '2-HIGH' THEN 'queued' WHEN '3-MEDIUM' THEN 'dispatched'
                            WHEN '4-NOT SPECIFIED' THEN 'acknowledged' ELSE 'completed' END AS status,
       CASE WHEN o_orderpriority = '1-URGENT' THEN concat('err-', CAST(o_orderkey AS VARCHAR(20))) END AS error_message,
       o_orderdate AS created_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' DAY END AS completed_at
FROM orders
""",
    # workers of daemons, one per nation
    "v_worker": r"""
SELECT user_id AS worker_id, concat('Worker-', CAST(user_id AS VARCHAR(20))) AS name, user_id % 25 AS daemon_id,
       CASE user_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'IDLE' WHEN 2 THEN 'Paused' ELSE 'stopped' END AS status,
       CASE WHEN user_id % 3 <> 0 THEN concat('https://h', CAST(user_id % 20 AS VARCHAR(20)), '.example.org/p/', CAST(max(event_id) AS VARCHAR(20))) END AS current_url,
       count(*) AS pages_processed, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS error_count
FROM events GROUP BY user_id
""",
    "v_daemon": r"""
SELECT n_nationkey AS id, concat('Node ', CAST(n_nationkey AS VARCHAR(20))) AS name,
       CASE WHEN n_nationkey % 3 = 0 THEN concat('{"daemonId":"d', CAST(n_nationkey AS VARCHAR(20)), '"}') ELSE '{}' END AS metadata,
       CASE WHEN n_nationkey % 4 = 1 THEN 'offline' WHEN n_nationkey % 7 = 6 THEN CAST(NULL AS VARCHAR(20)) ELSE 'online' END AS status
FROM nation
""",
    # events of a crawl, with payloads
    "v_event": r"""
SELECT event_id AS id, ts, user_id AS worker_id,
       CASE event_type WHEN 'view' THEN 'page-reported' WHEN 'click' THEN 'worker-metric' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'status-change'
            ELSE CASE WHEN event_id % 2 = 0 THEN 'frontier-prune' ELSE 'queue-change' END END AS type,
       CASE event_type WHEN 'view' THEN concat('{"url":"https://h', CAST(user_id % 20 AS VARCHAR(20)), '.example.org/p/', CAST(event_id AS VARCHAR(20)), '"}')
            WHEN 'click' THEN concat('{"pages_processed_total":', CAST(event_id % 100 AS VARCHAR(20)), ',"name":"x"}')
            WHEN 'error' THEN concat('{"message":"fetch failed for ', CAST(event_id AS VARCHAR(20)), '","level":"Warning"}')
            WHEN 'signup' THEN concat('{"status":"', CASE event_id % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Idle' ELSE 'Paused' END, '","previousStatus":"Idle","reason":" "}')
            ELSE concat('{"action":"claim","url":"https://h', CAST(user_id % 20 AS VARCHAR(20)), '.example.org/q","priority":', CAST(event_id % 7 AS VARCHAR(20)), '}') END AS payload
FROM events
""",
    # links to crawl, found on customers' pages
    "v_found": r"""
SELECT o_orderkey AS ord, concat('https://c', CAST(o_custkey % 50 AS VARCHAR(20)), '.example.org/') AS source_url,
       concat('https://c', CAST(o_orderkey % 40 AS VARCHAR(20)), '.', CASE o_orderkey % 3 WHEN 0 THEN 'gov.example' WHEN 1 THEN 'example' ELSE 'health.example' END, '.org/',
              CASE o_orderkey % 5 WHEN 0 THEN 'clinic' WHEN 1 THEN 'news' WHEN 2 THEN 'files/a.pdf' WHEN 3 THEN 'img/p.png' ELSE 'x' END, '/', CAST(o_orderkey % 997 AS VARCHAR(20))) AS url,
       CAST(o_orderkey % 6 AS INT) AS depth, o_orderdate AS found_at
FROM orders
""",
    # exact-duplicate corpus
    "v_content": r"""
SELECT doc_id AS id, concat('https://', source, '.example.org/', CAST(doc_id AS VARCHAR(20))) AS url, text AS html_content
FROM documents
""",
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A crawl table."""
    sql = VIEWS[name]
    for table in BASE:
        if table in sql:
            base(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(sql)


def with_views(sql: str) -> str:
    """The statement with the crawl tables it names as common table expressions."""
    used = [f"{n} AS ({q.strip()})" for n, q in VIEWS.items() if n in sql]
    lead = "WITH " + ",\n".join(used) if used else ""
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"{lead.replace('WITH ', 'WITH RECURSIVE ', 1)},\n{body[15:]}" if used else body
    if body.upper().startswith("WITH "):
        return f"{lead},\n{body[5:]}" if used else body
    return f"{lead}\n{body}"
