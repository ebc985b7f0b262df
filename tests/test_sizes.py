"""Steps whose time or memory grew faster than their input."""

import datetime as dt
import time as time_

from pyspark.sql import functions as F

from weir.functions import telemetry
from weir.operators import graph, search
from weir.plans import crawl_queries, document_queries, pipelines
from weir.streaming import arbitration
from weir.streaming import events as ev

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_assignments_meet_claims_of_their_span_only(spark):
    at = dt.datetime(2024, 1, 1, 23, 59)
    a = spark.createDataFrame([("s1", 1, at), ("s2", 2, at)], "seed_url string, worker_id long, assigned_at timestamp")
    c = spark.createDataFrame([(1, "S1", at + dt.timedelta(hours=24)), (1, "x", at - dt.timedelta(seconds=1)), (2, "x", at + dt.timedelta(hours=25))], "worker_id long, url string, claimed_at timestamp")
    out = arbitration.arbitrated(a, c, "24 hours")
    assert "(waits#" in plan(out)
    assert sorted((r.worker_id, r.claimed_url, r.outcome) for r in out.collect()) == [(1, "S1", "completed"), (2, None, "pending")]


def test_links_of_components_get_fewer_each_round(spark, monkeypatch):
    kept, store = [], graph.checkpointed

    def stored(df):
        out = store(df)
        if out.columns == ["a", "b"]:
            kept.append(out.count())
        return out

    monkeypatch.setattr(graph, "checkpointed", stored)
    edges = [(k, (7 * k) % 61) for k in range(61)]
    links = spark.createDataFrame(edges, "from_page long, to_page long")
    got = {r.id: r.component for r in graph.connected(spark.range(0, 60), links).collect()}
    assert got[0] == 0 and set(got) == set(range(60)) and all(got[a] == got[b] for a, b in edges if a < 60 and b < 60)
    assert len(kept) >= 2 and kept[-1] == 0 and all(b <= a // 2 for a, b in zip(kept, kept[1:]))


def test_the_link_export_is_no_single_task(spark, monkeypatch):
    asked, write = [], pipelines.write_csv
    monkeypatch.setattr(pipelines, "write_csv", lambda rows, path, one_file=False: (asked.append(one_file), write(rows, path, one_file)))
    document_queries.document_link_csv(spark, SF)
    assert asked == [False]


def test_a_trigram_that_all_rows_have_is_dealt_out(spark, tmp_path):
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        rows = spark.range(0, 60_000, 1, 8).select("id", F.lit("abc").alias("t"))
        search.write_postings(search.postings(rows, ["t"]), str(tmp_path / "p"))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    assert len(list((tmp_path / "p").glob("part=*/*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "p")).count() == 60_000


def test_a_log_asks_for_each_property_once(spark):
    rows = spark.createDataFrame([("error", '{"message":"m","message":"n","level":"L"}'), ("worker-log", "{cut"), ("frontier-prune", '{"url":"u","priority":3}'), ("status-change", '[{"url":"u"}]')], "type string, payload string")
    out = rows.withColumn("log", telemetry.logged(F.col("type"), F.col("payload"))).select("type", "log.level", "log.message")
    assert plan(out).count("get_json_object(") <= 11
    assert {r.type: (r.level, r.message) for r in out.collect()} == {"error": ("Error", "m"), "worker-log": ("Info", "worker-log"), "frontier-prune": ("Warning", "url=u | priority=3"), "status-change": ("Info", "status-change")}


def test_stored_html_is_parsed_once(spark):
    pages = crawl_queries.view(spark, SF, "v_page")
    queue = crawl_queries.view(spark, SF, "v_frontier").withColumn("source_url", F.lit(None).cast("string"))
    after = pipelines.reparse(pages, crawl_queries.view(spark, SF, "v_link"), queue, crawl_queries.now())
    assert not any("EvalPython" in plan(t) for t in after.values())


def test_a_neighbourhood_reads_stored_links(spark, monkeypatch):
    given, search_ = [], graph.neighbourhood
    monkeypatch.setattr(graph, "neighbourhood", lambda links, *k: (given.append(links), search_(links, *k))[1])
    crawl_queries.page_neighbourhood(spark, SF)
    assert "Join" not in plan(given[0]) and "Aggregate" not in plan(given[0])


def arbitrated_by_hand(seeds, claims, wait):
    out = {}
    for seed, worker, at in seeds:
        first = min(((t, u) for w, u, t in claims if w == worker and at <= t <= at + wait), default=(None, None))
        out[(seed, worker, at)] = first[1]
    return out


def busy(n):
    """Assignments and claims of a busy worker, a lazy one and none, at distinct times of four hours."""
    start = dt.datetime(2024, 1, 1, 22)
    at = lambda k: start + dt.timedelta(seconds=k)
    seeds = [(f"S{k % 3}", (7, 7, 8, None)[k % 4], at(k * 7919 % 14400)) for k in range(n)]
    claims = [(7 if k % 9 else 8, f"s{k % 3}", at(k * 6007 % 14400 + 0.5 * (k % 2))) for k in range(n) if k % 50 or k % 9]
    return seeds, claims


SEEDS, CLAIMS = "seed_url string, worker_id long, assigned_at timestamp", "worker_id long, url string, claimed_at timestamp"


def test_a_busy_worker_s_assignments_are_not_joined_with_its_claims(spark):
    seeds, claims = busy(600)
    out = arbitration.arbitrated(spark.createDataFrame(seeds, SEEDS), spark.createDataFrame(claims, CLAIMS), "20 minutes")
    assert "Join" not in plan(out)
    rows = out.collect()
    got = {(r.seed_url, r.worker_id, r.assigned_at): r.claimed_url for r in rows}
    assert len(rows) == len(got) and got == arbitrated_by_hand(seeds, claims, dt.timedelta(minutes=20))


def test_arbitration_keeps_what_waits_from_batch_to_batch(spark, tmp_path):
    seeds, claims = busy(600)
    for name, rows, schema, time in (("a", seeds, SEEDS, 2), ("c", claims, CLAIMS, 2)):
        rows = sorted(rows, key=lambda r: r[time])
        for k in range(3):
            spark.createDataFrame(rows[k * 200 : (k + 1) * 200], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time_.sleep(1.1)  # files are taken in the order of their seconds
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    rows = ev.run_to_end(arbitration.arbitrated(stream("a", SEEDS), stream("c", CLAIMS), "20 minutes"), "append", "busy").collect()
    mark = min(max(r[2] for r in seeds), max(r[2] for r in claims)) - dt.timedelta(minutes=1)
    wait = dt.timedelta(minutes=20)
    want = {k: v for k, v in arbitrated_by_hand(seeds, claims, wait).items() if k[2] + wait < mark}
    got = {(r.seed_url, r.worker_id, r.assigned_at): r.claimed_url for r in rows}
    assert len(rows) == len(got) and got == want and len({v for v in want.values()}) == 4
