"""Claims in rounds against the sequence they stand for, and the life of a lease as a stream."""

import datetime as dt
import inspect
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weir.operators import worker
from weir.streaming import events as ev
from weir.streaming import leases as ls

NOW = dt.datetime(2024, 1, 1, 12)
QUEUES = "worker_id long, url string, priority int, ord long"
REQUESTS = "url string, worker_id long, action string, ts timestamp, ord long"


def in_sequence(queues, workers, leased, tombs, cooling):
    """One worker after another: its own queue first, then the common one; a claimed URL's site is not ready for the next."""
    site = lambda u: re.match(r"https?://([^/:?#]+)", u)[1]
    busy, out = set(cooling), set()
    for w in sorted(workers):
        held = sorted(u for who, u in leased if who == w)
        if held:
            out.add((w, held[0], "renewed"))
            continue
        for own in (w, None):
            free = [(-p, k, u) for who, u, p, k in queues if who == own and u not in tombs and u not in {x for _, x in leased} and site(u) not in busy]
            if free:
                url = min(free)[2]
                out.add((w, url, "global" if own is None else "local"))
                busy.add(site(url))
                break
    return out


def claimed(spark, queues, workers, leased=(), tombs=(), cooling=()):
    made = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    leases = made([(w, u, NOW + dt.timedelta(seconds=9)) for w, u in leased], "worker_id long, url string, expires_at timestamp")
    ready = made([(s, NOW + dt.timedelta(seconds=9)) for s in cooling], "site_key string, ready_at timestamp")
    rows = worker.local_claims(made(queues, QUEUES), made([(w,) for w in workers], "worker_id long"), leases, made([(u,) for u in tombs], "url string"), ready, F.lit(NOW)).collect()
    assert {r.expires_at for r in rows} <= {NOW + dt.timedelta(seconds=30)}
    return [(r.worker_id, r.url, r.source) for r in rows]


def test_a_url_in_two_queues_is_claimed_once(spark):
    got = claimed(spark, [(1, "http://a/x", 1, 1), (2, "http://a/x", 1, 1)], [1, 2])
    assert got == [(1, "http://a/x", "local")]


def test_workers_without_a_queue_are_served(spark):
    got = claimed(spark, [(None, "http://a/x", 1, 1), (None, "http://b/x", 3, 2), (None, "http://a/y", 2, 3)], [5, 6, 7])
    assert sorted(got) == [(5, "http://b/x", "global"), (6, "http://a/y", "global")]


def test_a_worker_before_takes_the_site_of_one_after(spark):
    # 1 wants the best common site, which 2 has in its own queue; 2 goes on to its next one and 3, which had that, to another
    queues = [(2, "http://a/own", 9, 1), (2, "http://b/own", 1, 2), (3, "http://b/x", 9, 3), (None, "http://a/c", 5, 4), (None, "http://d/c", 1, 5)]
    assert set(claimed(spark, queues, [1, 2, 3])) == in_sequence(queues, [1, 2, 3], (), (), ()) == {(1, "http://a/c", "global"), (2, "http://b/own", "local"), (3, "http://d/c", "global")}


@pytest.mark.parametrize("seed", range(4))
def test_rounds_end_in_the_claims_of_the_sequence(spark, seed):
    rng = random.Random(seed)
    sites = [f"s{k}" for k in range(14)]
    urls = [f"http://{rng.choice(sites)}/{k}" for k in range(60)]
    workers = list(range(18))
    queues = [(rng.choice([None, *range(12)]), rng.choice(urls), rng.randrange(4), k) for k in range(90)]
    leased = [(w, u) for w, u in zip(rng.sample(range(25), 3), rng.sample(urls, 3), strict=True)]
    tombs, cooling = rng.sample(urls, 6), rng.sample(sites, 2)
    got = claimed(spark, queues, workers, leased, tombs, cooling)
    assert set(got) == in_sequence(queues, workers, leased, tombs, cooling)
    assert len({u for _, u, _ in got}) == len(got) == len({w for w, _, _ in got})


def requests(spark, tmp_path, batches):
    """A stream with one file, and so one batch, for each list of (url, worker, action, second)."""
    for k, rows in enumerate(batches):
        made = [(u, w, a, NOW + dt.timedelta(seconds=s), 100 * k + n) for n, (u, w, a, s) in enumerate(rows)]
        spark.createDataFrame(made, REQUESTS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def told(spark, tmp_path, name, *batches, **k):
    rows = ev.run_to_end(ls.leases(requests(spark, tmp_path, batches), **k), "append", name, store=ls.STORE).collect()
    return [(r.url, r.worker_id, r.action, r.outcome, int((r.at - NOW).total_seconds())) for r in sorted(rows, key=lambda r: (r.url, r.at, r.ord is not None, r.ord))]


def test_leases_are_exclusive_renewed_and_end(spark, tmp_path):
    rows = [("u", 1, "lease", -5), ("u", 1, "enqueue", 0), ("u", 2, "enqueue", 1), ("u", 1, "lease", 2), ("u", 2, "lease", 5), ("u", 2, "complete", 6), ("u", 1, "lease", 20), ("u", 2, "lease", 60), ("u", 2, "complete", 61)]
    assert [r[1:4] for r in told(spark, tmp_path, "exclusive", rows)] == [
        (1, "lease", "absent"), (1, "enqueue", "queued"), (2, "enqueue", "already-active"), (1, "lease", "leased"), (2, "lease", "refused"), (2, "complete", "rejected"), (1, "lease", "renewed"),
        (1, "expire", "requeued"), (2, "lease", "leased"), (2, "complete", "completed"),
    ]


def test_a_tombstoned_url_is_refused_for_its_time(spark, tmp_path):
    rows = [("u", 1, "enqueue", 0), ("u", 1, "lease", 1), ("u", 1, "complete", 2), ("u", 1, "enqueue", 3), ("u", 2, "lease", 602), ("u", 2, "enqueue", 603), ("u", 2, "lease", 604), ("u", 2, "release", 605), ("u", 3, "lease", 606)]
    assert [r[3] for r in told(spark, tmp_path, "tombs", rows)] == ["queued", "leased", "completed", "tombstoned", "tombstoned", "queued", "leased", "requeued", "leased"]


def test_a_lease_that_nothing_ends_expires_by_a_timer(spark, tmp_path):
    rows = [("u", 1, "enqueue", 0), ("u", 1, "lease", 0), ("v", 2, "enqueue", 700)]
    assert told(spark, tmp_path, "timer", rows) == [("u", 1, "enqueue", "queued", 0), ("u", 1, "lease", "leased", 0), ("u", 1, "expire", "requeued", 30), ("v", 2, "enqueue", "queued", 700)]


def test_state_outlives_a_batch(spark, tmp_path):
    got = told(spark, tmp_path, "batches", [("u", 1, "enqueue", 0), ("u", 1, "lease", 1), ("w", 9, "enqueue", 1)], [("u", 2, "lease", 9)], [("w", 3, "lease", 1500), ("u", 2, "lease", 1500)])
    assert [r[1:] for r in got if r[0] == "u"] == [(1, "enqueue", "queued", 0), (1, "lease", "leased", 1), (2, "lease", "refused", 9), (1, "expire", "requeued", 31), (2, "lease", "leased", 1500)]


def test_many_requests_of_one_url_ask_for_its_state_once(spark, tmp_path, monkeypatch):
    asked = []

    class State:
        value = None

        def get(self):
            asked.append("get")
            return self.value

        def clear(self):
            self.value = None

        def update(self, value):
            self.value = value

    class Handle:
        timers = set()

        def getValueState(self, name, schema):
            return State()

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.discard(t)

    life = ls.LeaseLife(30, 600)
    life.init(Handle())
    rows = pd.DataFrame({"micros": range(1, 50_002), "ord": [str(k) for k in range(50_001)], "worker_id": ["1"] * 50_000 + [None], "action": ["enqueue"] + ["lease"] * 50_000})
    told = pd.concat(life.handleInputRows(("u",), iter([rows[25_000:], rows[:25_000]]), None))
    assert len(asked) == 3 and told["outcome"].value_counts().to_dict() == {"renewed": 49_998, "queued": 1, "leased": 1, "refused": 1}
    assert life.lease.value == (1, 50_000 + 30_000_000) and life.queued.value is None and told["worker_id"].tolist()[-1] is None


def test_streams_may_take_as_long_as_their_input_needs():
    assert inspect.signature(ev.run_to_end).parameters["seconds"].default is None
