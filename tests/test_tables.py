"""Plans and contents of tables: by day, by bucket, common contents, posting lists, dead letters, arbitration."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weir.functions import html as H
from weir.operators import frontier as fr
from weir.operators import ingest, pages, search, snapshots
from weir.plans import pipelines
from weir.streaming import arbitration, requests, retention
from weir.streaming import events as ev

NOW = dt.datetime(2024, 1, 20, 12)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- by day -------------------------------------------------------------------------------------------------------------

def logs(spark, out):
    rows = [(k, NOW - dt.timedelta(hours=7 * k), k % 3) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp, n int")
    for number in range(3):
        retention.append_batch(df.where(F.col("n") == number), out, "created_at", number)
    return {i for i, _, _ in rows}, dict((i, t) for i, t, _ in rows)


def test_old_days_leave_and_no_other_day_is_written(spark, tmp_path):
    out = str(tmp_path / "t")
    ids, at = logs(spark, out)
    assert {r.id for r in spark.read.parquet(out).collect()} == ids
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    done = retention.expire(spark, out, NOW, 14)
    assert {r.id for r in spark.read.parquet(out).collect()} == {i for i, t in at.items() if t >= NOW - dt.timedelta(days=14)}
    assert done[-1] == "2024-01-06" and all(d < "2024-01-06" for d in done[:-1])
    same = {p: t for p, t in files.items() if p.parent.parent.name > "day=2024-01-06"}
    assert same and all(p.exists() and p.stat().st_mtime_ns == t for p, t in same.items())
    assert retention.expire(spark, out, NOW, 14) == ["2024-01-06"]


def test_a_batch_that_is_run_again_is_kept_once(spark, tmp_path):
    out = str(tmp_path / "t")
    logs(spark, out)
    ids, _ = logs(spark, out)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == sorted(ids)


def test_reading_from_a_time_on_reads_those_days_only(spark, tmp_path):
    out = str(tmp_path / "t")
    logs(spark, out)
    df = retention.since(spark, out, NOW - dt.timedelta(days=2))
    filters = plan(df).split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in filters and ">= 2024-01-18" in filters
    assert df.count() == 7


def test_cleaning_waits_between_runs(spark, tmp_path):
    last = NOW - dt.timedelta(minutes=29)
    assert retention.clean(spark, str(tmp_path), NOW, last) == last
    assert retention.clean(spark, str(tmp_path), NOW, NOW - dt.timedelta(minutes=30)) == NOW


# --- by bucket ----------------------------------------------------------------------------------------------------------

@pytest.fixture
def kept(spark):
    rows = [(k, f"https://h{k % 7}.org/{k}", k % 5, None, k % 3, ("QUEUED", "LOCKED", "COMPLETED", "FAILED")[k % 4], NOW, None, None, None, k % 2) for k in range(1, 200)]
    schema = "id long, url string, priority int, source_url string, depth int, state string, discovered_at timestamp, dequeued_at timestamp, finished_at timestamp, locked_at timestamp, locked_by_worker_id int"
    f = spark.createDataFrame(rows, schema)
    yield f, snapshots.keep(f, "weir_test_frontier", "url", 8)
    spark.sql("DROP TABLE IF EXISTS weir_test_frontier")


def shuffled_scans(df):
    """Exchanges below which a snapshot's file scan lies, by the plan's indentation."""
    lines, found = plan(df).split("\n"), 0
    for k, line in enumerate(lines):
        if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            for below in lines[k + 1 :]:
                if len(below) - len(below.lstrip(" :+-")) <= depth:
                    break
                found += "weir_test_frontier" in below and "Scan" in below
    return found


def batch_of(spark):
    rows = [(f"https://h{k % 7}.org/{k}", 9, 1, None, NOW, k) for k in range(150, 260)]
    return spark.createDataFrame(rows, "url string, priority int, depth int, source_url string, discovered_at timestamp, ord int")


def test_transitions_of_a_bucketed_snapshot_shuffle_the_batch_alone(spark, kept):
    f, snapshot = kept
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = fr.merge_batch(snapshots.dealt(batch_of(spark), 8))
        after = fr.enqueue(snapshot, batch)
        old = after.where("id < 200")
        assert shuffled_scans(old) <= 0 or "weir_test_frontier" not in plan(old)
        again = {r.url: (r.id, r.state, r.priority) for r in after.collect()}
        assert again == {r.url: (r.id, r.state, r.priority) for r in fr.enqueue(f, fr.merge_batch(batch_of(spark))).collect()}
        gone = fr.prune(snapshot, snapshots.dealt(spark.createDataFrame([("https://h3.org/3", 1), ("https://h4.org/4", 1)], "url string, worker_id int"), 8))
        assert "SortMergeJoin" in plan(gone) and "weir_test_frontier" in plan(gone) and shuffled_scans(gone) == 0
        plain = fr.prune(f.repartition(3), spark.createDataFrame([("https://h3.org/3", 1), ("https://h4.org/4", 1)], "url string, worker_id int"))
        assert sorted((r.id, r.state) for r in gone.collect()) == sorted((r.id, r.state) for r in plain.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_next_snapshot_takes_the_place_of_the_last(spark, kept):
    _, snapshot = kept
    snapshots.replace(fr.cleanup(snapshot, ["failed"]), "weir_test_frontier", "url", 8)
    assert {r.state for r in spark.table("weir_test_frontier").collect()} == {"QUEUED", "LOCKED", "COMPLETED"}


# --- common contents ----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("common", [10_000, 5])
def test_a_content_that_a_third_of_the_pages_have(spark, monkeypatch, common):
    monkeypatch.setattr(ingest, "COMMON", common)
    known = spark.createDataFrame([(k, f"https://a.org/{k}", "HTML", "blank" if k % 3 == 0 else f"text {k}", None, None, NOW) for k in range(1, 61)], "id long, url string, page_type_code string, html_content string, content_hash string, duplicate_of_page_id long, accessed_time timestamp")
    known = known.withColumn("content_hash", F.sha2("html_content", 256))
    came = spark.createDataFrame([(f"https://a.org/{k}", "HTML", "blank" if k % 2 else f"text {k}", NOW) for k in range(40, 140)], "url string, page_type_code string, html_content string, accessed_time timestamp")
    rows = {r.id: r for r in ingest.upsert_pages(known, came).collect()}
    assert len(rows) == 139
    for k, r in rows.items():
        blank = k % 2 == 1 if int(r.url.rsplit("/", 1)[1]) >= 40 and k < 61 else None
        if r.status is not None and blank:
            assert (r.page_type_code, r.duplicate_of_page_id, r.html_content) == ("DUPLICATE", 3, None)
    assert sum(r.status == "duplicate_content" for r in rows.values()) == 40
    same = {r.id: r.canonical_id for r in ingest.canonical_pages(known).collect()}
    assert same == {k: 3 if k % 3 == 0 else k for k in range(1, 61)}
    told = ingest.classify(spark.createDataFrame([(k, f"https://b.org/{k}", "blank" if k % 2 else "new") for k in range(30)], "id long, url string, t string").withColumn("content_hash", F.sha2("t", 256)), known)
    assert {(r.id, r.kind, r.page_id) for r in told.collect()} == {(k, "duplicate_content", 3) if k % 2 else (k, "new_html", None) for k in range(30)}


def test_no_task_gets_a_whole_common_content(spark, monkeypatch):
    monkeypatch.setattr(ingest, "COMMON", 100)
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "blank").otherwise(F.col("id").cast("string")).alias("content_hash"), "id")
    known = spark.createDataFrame([("blank", 0), ("7", 7)], "content_hash string, first long")
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        got = ingest.looked_up(rows, known, "id")
        assert got.where("first = 0").count() == 10_000 and got.where("first = 7").count() == 1 and got.count() == 30_000
        sizes = [r["count"] for r in got.where("first = 0").groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2000
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


# --- posting lists ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("term", ["Straße", "str", "a%c", "x_z 1", "no such", "ab", "%", "İ", "longer than any text here"])
def test_search_by_postings_equals_a_scan(spark, tmp_path, term):
    texts = ["Die STRASSE und die Straße", "abc axc", "xyz 1", "", None, "ab", "a", "xz 1", "i̇stanbul", "aBc%"]
    rows = spark.createDataFrame([(k, f"https://a.org/{k}", t) for k, t in enumerate(texts)], "id long, url string, html_content string")
    path = str(tmp_path / "postings")
    search.write_postings(search.postings(rows, ["url", "html_content"]), path)
    index = spark.read.parquet(path)
    got = {r.id for r in search.matching(rows, index, term, ["url", "html_content"]).collect()}
    assert got == {r.id for r in pages.matching(rows, term).collect()}


def test_a_search_reads_the_parts_of_its_trigrams(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"text number {k}") for k in range(2000)], "id long, t string")
    path = str(tmp_path / "postings")
    search.write_postings(search.postings(rows, ["t"]), path)
    index = spark.read.parquet(path)
    found = search.candidates(index, "r 1234")
    filters = plan(found).split("PartitionFilters: [")[1].split("\n")[0]
    assert "part" in filters and "PushedFilters: [In(trigram" in filters
    assert {r.id for r in found.collect()} == {1234}


# --- HTML as rows and CSV -----------------------------------------------------------------------------------------------

def test_html_as_rows(spark):
    html = '<a href="/b">b</a><a href="/b">b</a><a href="#x" onclick="location.href=\'/s\'">s</a><div onclick="window.open(\'/w\')"></div><img data-src="/i.png" srcset="/i.png 1x, /j.jpg 2x"><source src="/v.webp"><a href="/k.gif">k</a>'
    rows = H.asset_rows(spark.createDataFrame([(1, "https://a.org/p", html), (2, "https://a.org/q", None), (3, None, "<p>")], "id long, url string, html_content string")).collect()
    assert sorted((r.id, r.kind, r.pos, r.asset_url) for r in rows) == [
        (1, "image", 0, "https://a.org/i.png"), (1, "image", 1, "https://a.org/j.jpg"), (1, "image", 2, "https://a.org/v.webp"), (1, "image", 3, "https://a.org/k.gif"),
        (1, "link", 0, "https://a.org/b"), (1, "link", 1, "https://a.org/s"), (1, "link", 2, "https://a.org/w"), (1, "script", 0, "https://a.org/s"), (1, "script", 1, "https://a.org/w"),
    ]


def test_csv_comes_back_as_it_was(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c\nd', "", True, NOW), (2, None, "\\N x", None, None)], "id long, t string, u string, b boolean, at timestamp").withColumn("at", F.col("at").cast("timestamp_ntz"))
    pipelines.write_csv(rows, str(tmp_path / "csv"), one_file=True)
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) == 1
    again = pipelines.read_csv(spark, str(tmp_path / "csv"), "id long, t string, u string, b boolean, at timestamp_ntz")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


# --- requests and arbitration -------------------------------------------------------------------------------------------

def test_bad_requests_are_kept_with_their_reason(spark, tmp_path):
    good = {"rawUrl": "https://a.org/x#y", "siteId": 3, "other": [1], "downloadResult": {"statusCode": 200, "pageTypeCode": " binary ", "htmlContent": "<p>"}}
    bodies = [json.dumps(good), json.dumps({"downloadResult": {"finalUrl": "https://a.org/z"}}), json.dumps({"rawUrl": "https://a.org", "siteId": "three"}), json.dumps({"rawUrl": " "}), "[1]", '{"rawUrl": ', " ", None]
    spark.createDataFrame([(k, b, NOW) for k, b in enumerate(bodies)], "id long, body string, received_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, body string, received_at timestamp").parquet(str(tmp_path / "in"))
    requests.stored(requests.ingest_requests(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    bad = spark.read.parquet(str(tmp_path / "out" / "dead_letter" / "batch=*")).collect()
    assert {r.id: (r.reason, r.body) for r in bad} == {k: (why, bodies[k]) for k, why in ((2, "wrong-type"), (3, "incomplete"), (4, "not-an-object"), (5, "malformed"), (6, "empty"), (7, "empty"))}
    pages_ = requests.page_batch(spark.read.parquet(str(tmp_path / "out" / "accepted" / "batch=*"))).collect()
    assert sorted((r.url, r.page_type_code, r.html_content) for r in pages_) == [("https://a.org/x", "BINARY", "<p>"), ("https://a.org/z", "HTML", None)]


def test_arbitration_tells_pending_once_the_wait_is_over(spark, tmp_path):
    at = lambda m: NOW + dt.timedelta(minutes=m)
    seeds = [("http://a/1", 1, at(0)), ("http://a/2", 2, at(0)), ("http://a/3", 3, at(0)), ("http://a/4", 4, at(0)), ("http://a/4", 4, at(0)), ("http://a/9", 9, at(500))]
    claims = [(1, "HTTP://A/1", at(3)), (1, "http://a/7", at(4)), (2, "http://a/7", at(1)), (2, "http://a/2", at(2)), (3, "http://a/3", at(11)), (8, "http://a/8", at(500))]
    spark.createDataFrame(seeds, "seed_url string, worker_id long, assigned_at timestamp").coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame(claims, "worker_id long, url string, claimed_at timestamp").coalesce(1).write.parquet(str(tmp_path / "c"))
    a = spark.readStream.schema("seed_url string, worker_id long, assigned_at timestamp").parquet(str(tmp_path / "a"))
    c = spark.readStream.schema("worker_id long, url string, claimed_at timestamp").parquet(str(tmp_path / "c"))
    got = ev.run_to_end(arbitration.arbitrated(a, c), "append", "arbitrated").collect()
    assert sorted((r.worker_id, r.claimed_url, r.outcome) for r in got) == [(1, "HTTP://A/1", "completed"), (2, "http://a/7", "conflict"), (3, None, "pending"), (4, None, "pending")]
