"""The library's operators over the crawl tables, each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions import html as H
from weir.functions import scoring
from weir.functions import url as U
from weir.operators import activity, frontier, graph, ingest
from weir.operators import pages as P
from weir.operators.numbering import checkpointed
from weir.plans import pipelines
from weir.sources.fixtures import base, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2024-01-20 12:00:00"
POLICY = scoring.Policy(keywords=["en", "html", "page", "blog"], suffixes=["example.org", ".spam-farm.example.net"])


def now():
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


def query(sql: str | None = None):
    """Registers a function under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def _pages(spark, d) -> DataFrame:
    """Pages with a source and depth made from their id, and scored."""
    rows = view(spark, d, "v_page").withColumns({"source_url": F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://"), F.col("domain"), F.lit("/"))), "depth": (F.col("id") % 4).cast("int")})
    return P.scored(rows, POLICY)


_HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"
_HAY = f"lower({_HOST} || ' ' || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) || ' ' || CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '\\?([^#]*)', 1) ELSE '' END)"
_SUFFIX = f"({_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org' OR {_HOST} = 'spam-farm.example.net' OR {_HOST} LIKE '%.spam-farm.example.net')"
_KEYWORDS = " + ".join(f"CASE WHEN contains({_HAY}, '{k}') THEN 5.0 ELSE 0.0 END" for k in POLICY.keywords)
SCORED = f"""scored AS (SELECT *, round(CAST(greatest(0.0, b + CASE WHEN has_keyword OR has_suffix OR has_same_host THEN 0.0 ELSE 0.1 END - 0.2 * depth) AS DOUBLE), 6) AS score FROM (
 SELECT *, CASE WHEN has_same_host THEN 10.0 ELSE 0.0 END + CASE WHEN has_suffix THEN 20.0 ELSE 0.0 END + kw AS b FROM (
  SELECT *, kw > 0 AS has_keyword, {_SUFFIX} AS has_suffix, id % 3 = 0 AS has_same_host FROM (
   SELECT *, CAST(id % 4 AS INT) AS depth, {_KEYWORDS} AS kw FROM v_page))))"""
COLLECTED = "url IS NOT NULL AND page_type_code IS DISTINCT FROM 'FRONTIER'"


@query("SELECT domain, count(*) AS n FROM v_page GROUP BY domain")
def page_host_counts(spark, d):
    return view(spark, d, "v_page").select(U.host(F.col("url")).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS INT) AS n_links FROM pages""")
def page_link_counts(spark, d):
    return base(spark, d, "pages").select("page_id", F.size(H.anchor_hrefs(F.col("html"))).alias("n_links"))


@query("""SELECT page_id, href, CAST(min(pos) AS INT) AS pos FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS pos FROM
 (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) AS l FROM pages)) GROUP BY page_id, href""")
def page_links_exploded(spark, d):
    rows = base(spark, d, "pages").select("page_id", F.posexplode(H.anchor_hrefs(F.col("html"))).alias("pos", "href"))
    return rows.groupBy("page_id", "href").agg(F.min("pos").alias("pos"))


@query("SELECT page_id, nullif(regexp_replace(trim(url), '#.*$', ''), '') AS url FROM pages")
def url_fragment_strip(spark, d):
    return base(spark, d, "pages").select("page_id", U.without_fragment(F.col("url")).alias("url"))


@query("""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS url FROM
 (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|fbclid|gclid|igshid|mc_cid|mc_eid|ref|ref_src)(=|$)')) AS q FROM pages)""")
def url_tracking_strip(spark, d):
    return base(spark, d, "pages").select("page_id", U.without_tracking(F.col("url")).alias("url"))


@query("""SELECT id, CASE WHEN len(p) <= 2 THEN array_to_string(p, '.') WHEN len(p[-1]) = 2 AND len(p[-2]) <= 3 THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS root
 FROM (SELECT id, string_split(domain, '.') AS p FROM v_page)""")
def url_registrable_domain(spark, d):
    return view(spark, d, "v_page").select("id", U.registrable_domain(F.col("domain")).alias("root"))


def _contents(spark, d) -> DataFrame:
    return view(spark, d, "v_content").withColumn("content_hash", F.sha2("html_content", 256)).drop("html_content")


@query("SELECT sha256(html_content) AS content_hash, count(*) AS n, min(id) AS first_id FROM v_content GROUP BY sha256(html_content) HAVING count(*) > 1")
def content_hash_duplicates(spark, d):
    return ingest.duplicate_groups(_contents(spark, d))


@query("SELECT id, min(id) OVER (PARTITION BY sha256(html_content)) AS canonical_id FROM v_content")
def canonical_page_of_hash(spark, d):
    return ingest.canonical_pages(_contents(spark, d)).select("id", "canonical_id")


@query("""WITH k AS (SELECT id, url, sha256(html_content) AS h FROM v_content WHERE id % 2 = 0), c AS (SELECT id, url, sha256(html_content) AS h FROM v_content WHERE id % 5 <> 0),
 bu AS (SELECT url, min(id) AS u FROM k GROUP BY url), bh AS (SELECT h, min(id) AS x FROM k GROUP BY h)
SELECT c.id, CASE WHEN u IS NOT NULL THEN 'known_url' WHEN x IS NOT NULL THEN 'duplicate_content' ELSE 'new_html' END AS kind, coalesce(u, x) AS page_id FROM c LEFT JOIN bu USING (url) LEFT JOIN bh ON c.h = bh.h""")
def classify_documents(spark, d):
    """Two roles made of one table: even ids are known pages, ids not divisible by five candidates."""
    rows = _contents(spark, d)
    return ingest.classify(rows.where("id % 5 <> 0"), rows.where("id % 2 = 0")).select("id", "kind", "page_id")


@query(f"WITH {SCORED} SELECT id, url, domain AS site_domain, score FROM scored WHERE page_type_code = 'HTML' AND (url ILIKE '%blog%' OR html_content ILIKE '%blog%') ORDER BY accessed_time DESC NULLS LAST, id LIMIT 50")
def page_search_latest(spark, d):
    return P.search(_pages(spark, d), view(spark, d, "v_site"), " blog ", "html").select("id", "url", "site_domain", "score")


@query(f"WITH {SCORED} SELECT id, url, domain AS site_domain, score FROM scored ORDER BY score DESC, accessed_time DESC NULLS LAST, id LIMIT 25 OFFSET 10")
def page_search_best_score(spark, d):
    return P.search(_pages(spark, d), view(spark, d, "v_site"), None, "ALL", "best_score", 10, 25).select("id", "url", "site_domain", "score")


@query("SELECT count(*) AS n FROM v_page WHERE duplicate_of_page_id IS NOT NULL AND (url ILIKE '%en%' OR html_content ILIKE '%en%')")
def page_search_count(spark, d):
    return P.matching(P.of_type(view(spark, d, "v_page"), "duplicate"), "en").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCORED} SELECT id, url, score, has_keyword, has_suffix, has_same_host FROM scored WHERE {COLLECTED} ORDER BY score DESC, accessed_time DESC NULLS LAST, id LIMIT 100")
def relevance_report(spark, d):
    return P.relevance_report(P.collected(_pages(spark, d))).select("id", "url", "score", "has_keyword", "has_suffix", "has_same_host")


@query(f"""WITH {SCORED}, t AS (SELECT * FROM scored WHERE {COLLECTED} ORDER BY score DESC, accessed_time DESC NULLS LAST, id LIMIT 5000)
SELECT count(*) AS n, count(*) FILTER (score > 0) AS positive, count(*) FILTER (has_keyword) AS keyword, count(*) FILTER (has_suffix) AS suffix, count(*) FILTER (has_same_host) AS same_host, count(*) FILTER (has_keyword OR has_suffix) AS relevant,
 round(avg(score), 6) AS average, list_sort(list(score))[count(*) // 2 + 1] AS median, max(score) AS top FROM t""")
def relevance_summary(spark, d):
    return P.relevance_summary(P.collected(_pages(spark, d)))


@query(f"""WITH {SCORED}, c AS (SELECT domain, score, accessed_time FROM scored WHERE {COLLECTED}),
 a AS (SELECT domain, count(*) AS n, avg(score) AS average, list_sort(list(score))[count(*) // 2 + 1] AS median, max(score) AS top, max(accessed_time) AS last_access FROM c GROUP BY domain)
SELECT s.domain, coalesce(n, 0) AS n_pages, round(coalesce(average, 0.0), 6) AS average, coalesce(median, 0.0) AS median, coalesce(top, 0.0) AS top, last_access,
 round(CASE WHEN n > 0 THEN 0.65 * average + 0.35 * top + least(3.0, log10(n + 1.0)) ELSE 0.0 END, 6) AS site_score FROM v_site s LEFT JOIN a USING (domain)""")
def site_summary(spark, d):
    return P.site_summary(_pages(spark, d), view(spark, d, "v_site"))


@query(f"""WITH {SCORED}, a AS (SELECT domain, count(*) AS n FROM scored WHERE {COLLECTED} GROUP BY domain)
SELECT s.domain, coalesce(n, 0) AS n_pages FROM v_site s LEFT JOIN a USING (domain) WHERE contains(lower(s.domain), 'blog') ORDER BY coalesce(n, 0) DESC, lower(s.domain), s.domain LIMIT 10""")
def site_order_pages(spark, d):
    return P.ordered_sites(P.site_summary(_pages(spark, d), view(spark, d, "v_site"), "blog"), "pages", 0, 10).select("domain", "n_pages")


def _any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_TEXT = "(lower(url) || ' ' || domain)"
_GRAPH = "CAST(0.05 AS DOUBLE) + " + " + ".join(f"CASE WHEN {_any_of(_TEXT, words)} THEN {w} ELSE 0.0 END" for w, words in scoring.GRAPH_FAMILIES)


@query(f"SELECT id, round(least(1.0, {_GRAPH}), 6) AS score FROM v_page")
def graph_score(spark, d):
    return view(spark, d, "v_page").select("id", F.round(scoring.graph_score(F.col("url"), F.col("domain")), 6).alias("score"))


@query(f"SELECT domain, count(*) AS n_pages, round(avg(s), 6) AS average, round(max(s), 6) AS top FROM (SELECT domain, least(1.0, {_GRAPH}) AS s FROM v_page) GROUP BY domain")
def site_graph_nodes(spark, d):
    return graph.site_nodes(view(spark, d, "v_page"))


@query(f"""SELECT id, 50 + CASE WHEN t THEN 40 ELSE 0 END + CASE WHEN h THEN 20 ELSE 0 END AS score, CASE WHEN t OR h THEN CASE WHEN t OR 70 >= 80 THEN 'high' ELSE 'medium' END ELSE 'medium' END AS level,
 'base=50' || CASE WHEN t THEN ', topic+40' ELSE '' END || CASE WHEN h THEN ', preferred-host+20' ELSE '' END AS reason FROM (SELECT id, contains(lower(url), 'html') OR contains(lower(url), 'utm') AS t, contains({_HOST}, 'blog') AS h FROM v_page)""")
def preferential_score(spark, d):
    return view(spark, d, "v_page").select("id", scoring.preferential(F.col("url"), F.lit(None).cast("string"), ["html", "utm"], ["blog"]).alias("p")).select("id", "p.*")


@query("SELECT from_site AS a, to_site AS b, n FROM (SELECT least(from_site, to_site) AS from_site, greatest(from_site, to_site) AS to_site, count(*) AS n FROM v_link WHERE from_site <> to_site GROUP BY least(from_site, to_site), greatest(from_site, to_site))")
def site_graph_edges(spark, d):
    return graph.site_edges(view(spark, d, "v_link")).select(F.col("site_a").alias("a"), F.col("site_b").alias("b"), "n")


@query("SELECT to_site AS site, count(*) AS n FROM v_link WHERE from_site <> to_site AND to_site > 0 GROUP BY to_site")
def site_backlinks(spark, d):
    return graph.backlinks(view(spark, d, "v_link"))


@query("SELECT from_site AS site, count(*) AS n FROM v_link WHERE from_site > 0 GROUP BY from_site")
def site_outbound(spark, d):
    return graph.outbound(view(spark, d, "v_link"))


@query("SELECT to_page, count(*) AS n FROM v_link GROUP BY to_page")
def incoming_link_counts(spark, d):
    return graph.incoming_counts(view(spark, d, "v_link"))


@query("""SELECT page, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, round(log10(sum(i) + 1) * 10, 6) AS backlink_score FROM
 (SELECT from_page AS page, 0 AS i, 1 AS o FROM v_link UNION ALL SELECT to_page, 1, 0 FROM v_link) GROUP BY page""")
def page_degree(spark, d):
    return graph.degrees(view(spark, d, "v_link"))


@query("""WITH o AS (SELECT from_page, to_page, row_number() OVER (ORDER BY greatest(from_page, to_page) DESC, from_page, to_page) AS ord FROM v_link), l AS (SELECT * FROM o WHERE ord <= 2000),
 n AS (SELECT page, min(k) AS k FROM (SELECT from_page AS page, 2 * ord AS k FROM l UNION ALL SELECT to_page, 2 * ord + 1 FROM l) GROUP BY page ORDER BY k LIMIT 100)
SELECT from_page, to_page FROM l WHERE from_page IN (SELECT page FROM n) AND to_page IN (SELECT page FROM n)""")
def recent_links(spark, d):
    return graph.recent_links(view(spark, d, "v_link"), 100)


@query(f"""WITH s AS (SELECT domain, count(*) AS n_pages, round(avg(x), 6) AS average, round(max(x), 6) AS top FROM (SELECT domain, least(1.0, {_GRAPH}) AS x FROM v_page) GROUP BY domain),
 r AS (SELECT *, array_to_string(string_split(domain, '.')[-2:], '.') AS root FROM s)
SELECT root, count(*) AS n_sites, CAST(sum(n_pages) AS BIGINT) AS n_pages, round(sum(average * n_pages) / sum(n_pages), 6) AS average, max(top) AS top FROM r GROUP BY root""")
def domain_roll_up(spark, d):
    return graph.domain_roll_up(graph.site_nodes(view(spark, d, "v_page")))


_STATUS = ", ".join(f"count(*) FILTER (state = '{s}') AS {s.lower()}" for s in ("QUEUED", "LOCKED", "PROCESSING", "COMPLETED", "DUPLICATE", "FAILED"))


@query(f"SELECT count(*) AS known_urls, {_STATUS}, count(*) FILTER (memory_cached) AS memory_cached, count(*) FILTER (state IN ('LOCKED', 'PROCESSING')) AS active_leases, count(*) FILTER (state IN ('COMPLETED', 'DUPLICATE', 'FAILED')) AS tombstones FROM v_frontier")
def frontier_status(spark, d):
    return frontier.status(view(spark, d, "v_frontier"))


@query("SELECT state, count(*) AS n FROM v_frontier GROUP BY state")
def frontier_by_state(spark, d):
    return frontier.by_state(view(spark, d, "v_frontier"))


@query("SELECT id, url, priority FROM v_frontier WHERE state = 'QUEUED' ORDER BY priority DESC, discovered_at, id LIMIT 20")
def frontier_top(spark, d):
    return frontier.top_queued(view(spark, d, "v_frontier")).select("id", "url", "priority")


@query("SELECT id, state, locked_at FROM v_frontier WHERE state IN ('LOCKED', 'PROCESSING') ORDER BY locked_at DESC NULLS LAST, priority DESC, discovered_at, id LIMIT 50")
def frontier_locked(spark, d):
    return frontier.top_locked(view(spark, d, "v_frontier"), 50).select("id", "state", "locked_at")


@query(f"""SELECT id, CASE WHEN x THEN 'QUEUED' ELSE state END AS state, CASE WHEN NOT x THEN locked_at END AS locked_at FROM
 (SELECT *, coalesce(state = 'LOCKED' AND locked_at < TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND, false) AS x FROM v_frontier)""")
def frontier_expired(spark, d):
    return frontier.requeue_expired(view(spark, d, "v_frontier"), now(), 9999).select("id", "state", "locked_at")


_HEADS = "h AS (SELECT *, row_number() OVER (ORDER BY priority DESC, discovered_at, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY priority DESC, discovered_at, id) AS r FROM v_frontier WHERE state = 'QUEUED') WHERE r = 1)"


@query(f"WITH {_HEADS} SELECT site_key, id, priority, CAST(rank AS INT) AS rank FROM h")
def frontier_claim_per_site(spark, d):
    return frontier.ranked_heads(view(spark, d, "v_frontier"), None, now()).select("site_key", "id", "priority", F.col("rank").cast("int").alias("rank"))


@query(f"WITH {_HEADS} SELECT w AS worker_id, id, url FROM h JOIN (VALUES (1, 9101), (2, 9102), (3, 7)) v(k, w) ON rank = k")
def frontier_dequeue(spark, d):
    return frontier.dequeue(view(spark, d, "v_frontier"), [9101, -1, 9102, 9101, 7, 8], 3, now()).select("worker_id", "id", "url")


def _batch(spark, d) -> DataFrame:
    rows = view(spark, d, "v_frontier").select(F.concat(F.lit("https://n"), (F.col("id") % 97).cast("string"), F.lit(".example.org/")).alias("url"), "priority", (F.col("depth") - 1).alias("depth"), F.when(F.col("id") % 2 == 0, F.col("url")).alias("source_url"), "discovered_at", F.col("id").alias("ord"))
    return frontier.merge_batch(rows)


@query("SELECT 'https://n' || CAST(id % 97 AS VARCHAR) || '.example.org/' AS url, max(priority) AS priority, min(greatest(depth - 1, 0)) AS depth, arg_min(url, id) FILTER (id % 2 = 0) AS source_url, min(discovered_at) AS discovered_at FROM v_frontier GROUP BY id % 97")
def frontier_enqueue_merge(spark, d):
    return _batch(spark, d)


@query("""WITH b AS (SELECT url, priority + 1 AS priority, 0 AS depth, discovered_at FROM v_frontier WHERE id % 3 = 0 UNION ALL SELECT 'https://new.example.org/' || CAST(id AS VARCHAR), 5, 0, discovered_at FROM v_frontier WHERE id % 50 = 0)
SELECT coalesce(f.url, b.url) AS url, greatest(f.priority, b.priority) AS priority, least(f.depth, b.depth) AS depth, CASE WHEN f.url IS NULL OR (b.url IS NOT NULL AND f.state IN ('COMPLETED', 'FAILED')) THEN 'QUEUED' ELSE f.state END AS state FROM v_frontier f FULL JOIN b ON f.url = b.url""")
def frontier_upsert(spark, d):
    f = view(spark, d, "v_frontier").withColumn("source_url", F.lit(None).cast("string"))
    new = lambda url, rows, p: rows.select(url.alias("url"), p.alias("priority"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("source_url"), "discovered_at", F.col("id").alias("ord"))
    batch = new(F.col("url"), f.where("id % 3 = 0"), F.col("priority") + 1).union(new(F.concat(F.lit("https://new.example.org/"), F.col("id").cast("string")), f.where("id % 50 = 0"), F.lit(5)))
    return frontier.enqueue(f, frontier.merge_batch(batch)).select("url", "priority", "depth", "state")


@query("SELECT id, CASE WHEN id % 2 = 0 AND (state = 'QUEUED' OR (state = 'LOCKED' AND locked_by_worker_id = 3)) THEN 'FAILED' ELSE state END AS state FROM v_frontier")
def frontier_prune(spark, d):
    f = view(spark, d, "v_frontier")
    return frontier.prune(f, f.where("id % 2 = 0").select("url", F.lit(3).alias("worker_id"))).select("id", "state")


@query("SELECT id, CASE WHEN state = 'LOCKED' AND locked_by_worker_id = id % 8 AND id % 3 <> 0 THEN CASE id % 3 WHEN 1 THEN 'COMPLETED' ELSE 'QUEUED' END ELSE state END AS state FROM v_frontier")
def frontier_complete(spark, d):
    f = view(spark, d, "v_frontier")
    results = f.where("id % 3 <> 0").select(F.col("id").alias("token"), "url", (F.col("id") % 8).cast("int").alias("worker_id"), F.when(F.col("id") % 3 == 1, " Done").otherwise("queued").alias("status"))
    return frontier.complete(f, results, now()).select("id", "state")


@query("SELECT id, state FROM v_frontier WHERE lower(state) NOT IN ('completed', 'failed')")
def frontier_cleanup(spark, d):
    return frontier.cleanup(view(spark, d, "v_frontier"), ["Completed", "FAILED"]).select("id", "state")


def _throughput(seconds: int, minutes: int, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"""SELECT {key}bucket, round(sum(metric_value), 6) AS value FROM (SELECT *, time_bucket(INTERVAL {seconds} SECOND, created_at, TIMESTAMP '2001-01-01') AS bucket FROM v_metric
 WHERE metric_name = 'page_processed' AND created_at >= TIMESTAMP '{NOW}' - INTERVAL {minutes} MINUTE AND created_at <= TIMESTAMP '{NOW}') GROUP BY {key}bucket"""


def _series(spark, d, seconds, minutes, by=None) -> DataFrame:
    out = activity.throughput(view(spark, d, "v_metric"), F.expr(f"TIMESTAMP '{NOW}'"), minutes, seconds, by)
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(_throughput(30, 1440))
def throughput_30s(spark, d):
    return _series(spark, d, 30, 1440)


@query(_throughput(420, 1440))
def throughput_7min_origin2001(spark, d):
    return _series(spark, d, 420, 9999)


@query(_throughput(600, 1440, "external_worker_id"))
def throughput_by_worker(spark, d):
    return _series(spark, d, 9999, 1440, ["external_worker_id"])


@query("SELECT id, 'k' AS metric_name, CAST(regexp_extract(payload, '(\\d+)', 1) AS DOUBLE) AS metric_value FROM v_metric WHERE metric_name = 'click' UNION ALL SELECT id, 'page_processed', 1.0 FROM v_metric WHERE metric_name = 'page_processed'")
def metric_explode(spark, d):
    kind = F.when(F.col("metric_name") == "click", "worker-metric").when(F.col("metric_name") == "page_processed", "page-reported").otherwise(F.col("metric_name"))
    return activity.metric_rows(view(spark, d, "v_metric").select("id", kind.alias("type"), "payload"))


@query("SELECT id, level, message FROM v_log WHERE lower(level) = 'error' AND message ILIKE '%value=1%' ORDER BY created_at DESC, id DESC LIMIT 120")
def log_search(spark, d):
    return activity.search_logs(view(spark, d, "v_log"), None, " ERROR ", "VALUE=1").select("id", "level", "message")


@query("SELECT level, count(*) AS n FROM v_log GROUP BY level")
def log_level_counts(spark, d):
    return activity.level_counts(view(spark, d, "v_log"))


@query("SELECT count(*) AS n FROM v_log WHERE lower(level) IN ('warning', 'error')")
def log_attention_count(spark, d):
    return activity.attention_count(view(spark, d, "v_log"))


@query(f"SELECT id FROM v_log WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY")
def retention_filter(spark, d):
    return activity.retained(view(spark, d, "v_log"), now(), 14).select("id")


@query("SELECT daemon_identifier, metric_name, arg_max(metric_value, (created_at, id)) AS value FROM v_metric GROUP BY daemon_identifier, metric_name")
def gauge_last_value(spark, d):
    return activity.gauges(view(spark, d, "v_metric"), ["daemon_identifier"])


@query("SELECT id, external_worker_id, previous, level FROM (SELECT *, lag(level) OVER (PARTITION BY external_worker_id ORDER BY created_at, id) AS previous FROM v_log) WHERE previous <> level")
def status_transitions(spark, d):
    rows = view(spark, d, "v_log").withColumnRenamed("created_at", "ts")
    return activity.transitions(rows, "external_worker_id", "level").select("id", "external_worker_id", "previous", "level")


@query("SELECT event_id AS id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 80")
def recent_events(spark, d):
    return activity.recent_events(base(spark, d, "events").withColumnRenamed("event_id", "id")).select("id", "event_type")


_COMMANDS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("queued", "dispatched", "acknowledged", "completed", "failed"))


@query(f"SELECT {_COMMANDS} FROM v_command WHERE created_at >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 24000 HOUR AND NOT (status = 'failed' AND command_type = 'start-daemon')")
def command_diagnostics(spark, d):
    return activity.command_diagnostics(view(spark, d, "v_command"), F.expr("TIMESTAMP_NTZ '2001-08-01 00:00:00'"), 24000)


@query("SELECT id, error_message FROM v_command WHERE status = 'failed' AND command_type <> 'start-daemon' ORDER BY created_at DESC, id DESC LIMIT 1")
def last_failure(spark, d):
    return activity.last_failure(view(spark, d, "v_command"))


@query("SELECT id, status FROM v_command WHERE status IN ('dispatched', 'acknowledged') ORDER BY created_at, id LIMIT 100")
def oldest_commands(spark, d):
    return activity.oldest(view(spark, d, "v_command"), ["dispatched", "acknowledged"]).select("id", "status")


@query("""WITH s AS (SELECT id FROM v_command WHERE status IN ('dispatched', 'acknowledged') AND completed_at IS NULL AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 45 SECOND ORDER BY created_at, id LIMIT 100)
SELECT c.id, CASE WHEN s.id IS NULL THEN status ELSE 'queued' END AS status, CASE WHEN s.id IS NULL THEN error_message ELSE 'Requeued stale in-flight command (' || status || ') after 45s timeout.' END AS error_message FROM v_command c LEFT JOIN s ON s.id = c.id""")
def stale_commands(spark, d):
    rows = view(spark, d, "v_command").withColumn("dispatched_at", F.col("created_at"))
    return activity.recover_stale(rows, F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")).select("id", "status", "error_message")


def _binary(spark, d) -> DataFrame:
    """A binary page for each part: its URL ends in one of many ways."""
    ends = F.array(*[F.lit(e) for e in ("/a.pdf", "/b.DOCX", "/dl?file=report.docx&x=1", "/c.ppt#p", "/i.JPEG", "/i.webp?s=1", "/none", "/get?x.pdf")])
    rows = base(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("https://x.example.org"), F.element_at(ends, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("url"))
    return rows.withColumn("page_type_code", F.lit("BINARY"))


def _stored(spark, d) -> DataFrame:
    return base(spark, d, "part").where("p_partkey % 16 = 6").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("page_id"), F.when(F.col("p_partkey") % 32 == 6, "pptx").otherwise("OTHER").alias("data_type_code"))


@query("""SELECT t AS type, count(p) AS n FROM (VALUES ('PDF'), ('DOC'), ('DOCX'), ('PPT'), ('PPTX')) v(t) LEFT JOIN
 (SELECT CASE WHEN p_partkey % 32 = 6 THEN 'PPTX' WHEN p_partkey % 8 IN (0, 7) THEN 'PDF' WHEN p_partkey % 8 IN (1, 2) THEN 'DOCX' WHEN p_partkey % 8 = 3 THEN 'PPT' END AS p FROM part) ON p = t GROUP BY t""")
def binary_type_counts(spark, d):
    return P.document_counts(_binary(spark, d), _stored(spark, d)).select("type", "n")


@query("""SELECT t AS type, count(p) AS n FROM (VALUES ('JPG'), ('PNG'), ('WEBP'), ('GIF'), ('SVG'), ('BMP'), ('TIFF'), ('ICO'), ('AVIF'), ('OTHER')) v(t) LEFT JOIN
 (SELECT CASE p_partkey % 8 WHEN 4 THEN 'JPG' WHEN 5 THEN 'WEBP' ELSE 'OTHER' END AS p FROM part) ON p = t GROUP BY t""")
def image_type_counts(spark, d):
    return P.image_counts(_binary(spark, d)).select("type", "n")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 16 <> 6")
def docs_missing_type(spark, d):
    return P.without_document_type(_binary(spark, d), _stored(spark, d)).select("id")


@query("SELECT p_partkey AS page_id, CASE WHEN p_partkey % 8 IN (0, 7) THEN 'PDF' WHEN p_partkey % 8 IN (1, 2) THEN 'DOCX' ELSE 'PPT' END AS data_type_code FROM part WHERE p_partkey % 8 IN (0, 1, 2, 3, 7)")
def document_type_backfill(spark, d):
    return pipelines.backfill_types(_binary(spark, d), _stored(spark, d))


@query("SELECT coalesce(page_type_code, 'Unknown') AS page_type, count(*) AS n FROM v_page GROUP BY 1")
def page_type_counts(spark, d):
    return P.type_counts(view(spark, d, "v_page"))


@query("""SELECT p.pages, p.html_pages, p.duplicates, (SELECT count(*) FROM v_site) AS sites, (SELECT count(*) FROM lineitem) AS images, round_even((SELECT count(*) FROM lineitem) / p.html_pages, 2) AS images_per_page
 FROM (SELECT count(*) AS pages, count(*) FILTER (page_type_code = 'HTML') AS html_pages, count(*) FILTER (page_type_code = 'DUPLICATE') AS duplicates FROM v_page) p""")
def dashboard_statistics(spark, d):
    return P.statistics(view(spark, d, "v_page"), view(spark, d, "v_site"), base(spark, d, "lineitem"))


def _workers(spark, d) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in ("active", "IDLE", "Paused", "stopped")]), (F.col("user_id") % 4 + 1).cast("int"))
    return base(spark, d, "events").groupBy(F.col("user_id").alias("worker_id")).agg(F.count_if(F.col("event_type") == "view").alias("pages_processed"), F.count_if(F.col("event_type") == "error").alias("error_count"), F.first(status).alias("status"))


_WORKERS = "w AS (SELECT user_id AS worker_id, count(*) FILTER (event_type = 'view') AS pages_processed, count(*) FILTER (event_type = 'error') AS error_count, CASE user_id % 4 WHEN 0 THEN 'Active' WHEN 1 THEN 'Idle' WHEN 2 THEN 'Paused' ELSE 'Stopped' END AS status FROM events GROUP BY user_id)"


@query(f"WITH {_WORKERS} SELECT s AS status, count(worker_id) AS n FROM (VALUES ('Active'), ('Idle'), ('Paused'), ('Stopped'), ('Error')) v(s) LEFT JOIN w ON status = s GROUP BY s")
def worker_status_counts(spark, d):
    return activity.status_counts(_workers(spark, d), ["Active", "Idle", "Paused", "Stopped", "Error"])


@query(f"WITH {_WORKERS} SELECT count(*) AS workers, count(*) FILTER (status = 'Active') AS active, CAST(sum(pages_processed) AS BIGINT) AS pages_processed, CAST(sum(error_count) AS BIGINT) AS errors FROM w")
def daemon_statistics(spark, d):
    return activity.daemon_statistics(_workers(spark, d))


@query(f"""WITH {_WORKERS}, c AS (SELECT status, count(*) AS n FROM w GROUP BY status)
SELECT status, n, round(coalesce(sum(360.0 * n / t) OVER (ORDER BY n DESC, status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) AS start, round(360.0 * n / t, 6) AS sweep FROM c, (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c)""")
def pie_shares(spark, d):
    return activity.shares(activity.status_counts(_workers(spark, d)), "status", "n")


@query(f"WITH {_WORKERS} SELECT id, (SELECT worker_id FROM w ORDER BY 2.0 * pages_processed - error_count DESC, worker_id LIMIT 1) AS worker_id FROM v_page")
def seed_assignment_weighted(spark, d):
    seeds = view(spark, d, "v_page").select("id", "url").withColumn("url", F.col("id").cast("string"))
    return activity.assign_seeds(seeds, _workers(spark, d), "weighted", 2.0, 1.0).select(F.col("url").cast("long").alias("id"), "worker_id")


def _groups(spark, d) -> DataFrame:
    return base(spark, d, "events").groupBy((F.col("user_id") % 10).alias("ord")).agg(F.array_sort(F.collect_set("user_id")).alias("worker_ids")).select("ord", F.concat(F.lit("g"), F.col("ord").cast("string")).alias("name"), "worker_ids", (~F.col("ord").isin(3, 7)).alias("enabled"), (F.col("ord") * 10).cast("int").alias("per_minute"))


@query("SELECT DISTINCT user_id AS worker_id, 60.0 / (user_id % 10 * 10) AS delay FROM events WHERE user_id % 10 NOT IN (0, 3, 7)")
def group_rate_limit(spark, d):
    return activity.group_delay(_groups(spark, d))


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def assigned_workers(spark, d):
    return activity.assigned_workers(_groups(spark, d))


@query("SELECT count(*) FILTER (a IS NULL) AS added, count(*) FILTER (b IS NULL) AS removed FROM (SELECT DISTINCT to_page AS a FROM v_link WHERE from_site < 12) x FULL JOIN (SELECT DISTINCT to_page AS b FROM v_link WHERE from_site > 3 AND to_site <> 5) y ON a = b")
def topology_changes(spark, d):
    links = view(spark, d, "v_link")
    return graph.changes(links.where("from_site < 12"), links.where("from_site > 3 and to_site <> 5"), ["to_page"])


@query("""WITH RECURSIVE e AS (SELECT from_page AS a, to_page AS b FROM v_link UNION SELECT to_page, from_page FROM v_link), cc(id, component) USING KEY (id) AS (SELECT DISTINCT a, a FROM e UNION
 SELECT e.b, min(cc.component) FROM cc JOIN e ON e.a = cc.id JOIN recurring.cc AS cur ON cur.id = e.b WHERE cc.component < cur.component GROUP BY e.b) SELECT id, component FROM cc""")
def connected_components(spark, d):
    links = checkpointed(view(spark, d, "v_link").select("from_page", "to_page"))
    nodes = links.select(F.explode(F.array("from_page", "to_page")).alias("id")).distinct()
    return graph.connected(nodes, links)


def sitemap_documents(spark, d) -> tuple[DataFrame, str]:
    """A sitemap (url, xml) of each domain and one of all of them, and the first domain."""
    loc = lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))
    pages = view(spark, d, "v_page").groupBy("domain").agg(F.concat(F.lit("<urlset>"), F.array_join(F.sort_array(F.collect_list(loc(F.regexp_replace("url", "&", "&amp;")))), ""), F.lit("</urlset>")).alias("xml"))
    own = pages.select(F.concat(F.lit("https://"), F.col("domain"), F.lit("/sitemap.xml")).alias("url"), "xml")
    top = own.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap>")))), ""), F.lit("</sitemapindex>")).alias("xml")).select(F.lit("root").alias("url"), "xml")
    host = pages.agg(F.min("domain")).first()[0]
    return own.union(top), host


@query("""WITH l AS (SELECT id AS source_page_id, url AS source_page_url, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || x AS candidate_url, t AS inferred_doc_type FROM v_page, (VALUES ('/files/a.pdf', 'PDF'), ('/dl?file=b.docx', 'DOCX')) v(x, t) WHERE page_type_code = 'HTML')
SELECT source_page_id, source_page_url, candidate_url, inferred_doc_type, 'link' AS discovered_in, p.id AS target_page_id, p.page_type_code AS target_page_type, p.http_status_code AS target_http_status, p.accessed_time AS target_accessed_time, f.state AS frontier_state,
 p.id IS NOT NULL AS has_page_row, p.http_status_code IS NOT NULL OR p.accessed_time IS NOT NULL AS has_fetch_result FROM l LEFT JOIN v_page p ON p.url = l.candidate_url LEFT JOIN v_frontier f ON f.url = l.candidate_url""")
def document_link_export(spark, d):
    pages = view(spark, d, "v_page")
    more = pages.withColumn("html_content", F.concat("html_content", F.lit('<a href="/files/a.pdf">a</a><a href="/dl?file=b.docx">b</a>')))
    return pipelines.export_rows(pipelines.document_links(more, view(spark, d, "v_frontier")))
