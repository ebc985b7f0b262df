"""The crawl's invariants: one row per URL, polite claims, leases that expire, ingest that can be repeated; streams against batches, components."""

import datetime as dt

from pyspark.sql import functions as F

from weir.operators import frontier as fr
from weir.operators import ingest
from weir.streaming import events as ev

COLUMNS = "id long, url string, priority int, source_url string, depth int, state string, discovered_at timestamp, dequeued_at timestamp, finished_at timestamp, locked_at timestamp, locked_by_worker_id int"
NOW = dt.datetime(2024, 1, 1, 12)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def batch(spark, rows):
    return fr.merge_batch(spark.createDataFrame([(u, p, 1, None, NOW, k) for k, (u, p) in enumerate(rows)], "url string, priority int, depth int, source_url string, discovered_at timestamp, ord int"))


def test_collisions_give_one_row(spark):
    f = empty(spark)
    for _ in range(3):
        f = fr.enqueue(f, batch(spark, [("https://a.org/x", 5)] * 4))
    rows = f.collect()
    assert [(r.url, r.state, r.priority) for r in rows] == [("https://a.org/x", "QUEUED", 5)]


def test_claims_are_polite_and_leases_expire(spark):
    now = F.lit(NOW)
    f = fr.enqueue(empty(spark), batch(spark, [("https://a.org/1", 980000), ("https://a.org/2", 970000), ("https://b.org/1", 960000)]))
    claims = fr.dequeue(f, [9101, 9102], 2, now)
    assert {(r.worker_id, r.url) for r in claims.collect()} == {(9101, "https://a.org/1"), (9102, "https://b.org/1")}
    f = fr.claim(f, claims, now)
    token = {r.url: r.id for r in f.collect()}
    done = lambda rows: spark.createDataFrame(rows, "token long, url string, worker_id int, status string")
    f2 = fr.complete(f, done([(token["https://a.org/1"], "https://a.org/1", 9101, "completed"), (token["https://b.org/1"], "https://b.org/1", 9101, "completed")]), now)
    assert {r.url: r.state for r in f2.collect()} == {"https://a.org/1": "COMPLETED", "https://a.org/2": "QUEUED", "https://b.org/1": "LOCKED"}
    again = fr.complete(f, done([(token["https://a.org/1"], "https://a.org/1", 9101, "queued")]), now)
    assert {r.url: r.state for r in again.collect()}["https://a.org/1"] == "QUEUED"
    later = F.lit(NOW + dt.timedelta(seconds=31))
    f3 = fr.requeue_expired(f2, later)
    assert {r.url: r.state for r in f3.collect()}["https://b.org/1"] == "QUEUED"
    stale = fr.complete(f3, done([(token["https://b.org/1"], "https://b.org/1", 9102, "completed")]), later)
    assert {r.url: r.state for r in stale.collect()}["https://b.org/1"] == "QUEUED"


def test_cooling_sites_are_passed_over(spark):
    f = fr.enqueue(empty(spark), batch(spark, [("https://a.org/1", 9), ("https://b.org/1", 8)]))
    ready = spark.createDataFrame([("a.org", NOW + dt.timedelta(seconds=5))], "site_key string, ready_at timestamp")
    assert [r.url for r in fr.dequeue(f, [1], 1, F.lit(NOW), ready).collect()] == ["https://b.org/1"]


def test_ingest_can_be_repeated(spark):
    pages = spark.createDataFrame([], "id long, url string, page_type_code string, html_content string, content_hash string, duplicate_of_page_id long, accessed_time timestamp")
    came = spark.createDataFrame([("https://a.org/1#x", "HTML", "<p>1</p>", NOW), ("https://a.org/1", "HTML", "<p>1</p>", NOW), ("https://a.org/2", "HTML", "<p>1</p>", NOW)], "url string, page_type_code string, html_content string, accessed_time timestamp")
    first = ingest.upsert_pages(pages, came)
    rows = sorted((r.id, r.url, r.page_type_code, r.duplicate_of_page_id, r.status) for r in first.collect())
    assert rows == [(1, "https://a.org/1", "HTML", None, "inserted"), (2, "https://a.org/2", "DUPLICATE", 1, "duplicate_content")]
    second = ingest.upsert_pages(first.drop("status"), came)
    assert sorted((r.id, r.page_type_code, r.status) for r in second.collect()) == [(1, "HTML", "updated"), (2, "DUPLICATE", "updated_duplicate")]
    links = spark.createDataFrame([], "from_page long, to_page long")
    new = spark.createDataFrame([(1, 5), (2, 5), (1, 5), (1, 1)], "from_page long, to_page long")
    assert [(r.from_page, r.to_page) for r in ingest.add_links(links, new, second).collect()] == [(1, 5)]


def stream_of(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    return spark.readStream.schema(schema).json(str(tmp_path / "in"))


def test_stream_throughput_equals_batch(spark, tmp_path):
    rows = [("page_processed", float(k % 3), NOW + dt.timedelta(seconds=17 * k)) for k in range(50)]
    schema = "metric_name string, metric_value double, created_at timestamp"
    got = ev.run_to_end(ev.throughput(stream_of(spark, tmp_path, rows, schema), 420), "complete", "series")
    from weir.operators.activity import throughput

    want = throughput(spark.createDataFrame(rows, schema), F.lit(NOW + dt.timedelta(hours=1)), 1440, 420)
    assert sorted((r.bucket, r.value) for r in got.collect()) == sorted((r.bucket, r.value) for r in want.collect())


def test_events_are_kept_in_three_tables(spark, tmp_path):
    rows = [("page-reported", None, 1, '{"url": "u"}', NOW), ("worker-metric", "d", 1, '{"pages_processed_total": 3}', NOW), ("status-change", "d", 1, '{"status": "active"}', NOW), ("", "d", None, "{}", NOW)]
    stream = ev.envelopes(stream_of(spark, tmp_path, rows, ev.EVENT))
    ev.persist(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    read = lambda n: spark.read.parquet(f"{tmp_path}/out/{n}")
    assert sorted((r.metric_name, r.metric_value) for r in read("worker_metric").collect()) == [("page_processed", 1.0), ("pages_processed_total", 3.0)]
    assert read("worker_log").count() == 2
    assert [r.status for r in ev.worker_states(read("worker_update")).collect()] == ["active"]


def plain_components(edges):
    """Union-find: each end's component, named by its smallest node."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components(spark):
    from weir.operators import graph

    edges = [(1, 9), (9, 4), (30, 31), (31, 30), (7, 7), (50, 49)] + [(k, k + 1) for k in range(100, 106)] + [(106, 60), (60, 71)]
    links = spark.createDataFrame(edges, "from_page long, to_page long")
    nodes = spark.createDataFrame([(x,) for e in edges for x in e] + [(99,)], "id long").distinct()
    got = {r.id: r.component for r in graph.connected(nodes, links).collect()}
    assert got == plain_components([*edges, (99, 99)])


def test_components_query_takes_every_link(spark):
    from weir.plans.crawl_queries import QUERIES
    from weir.sources.fixtures import view

    sf = "/root/testdata/sf0.001"
    edges = [(r.from_page, r.to_page) for r in view(spark, sf, "v_link").select("from_page", "to_page").collect()]
    rows = QUERIES["connected_components"](spark, sf).collect()
    assert len(rows) == len({r.id for r in rows}) and {r.id: r.component for r in rows} == plain_components(edges)
