"""The life of a crawl lease as a stream: queued, leased, renewed, completed or released, expired and queued again, tombstoned.

State is kept by URL in three variables, each with a timer of the requests' own time where it has an end.  Outcomes therefore depend on
the requests alone, and a run over given input ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from weir.operators.frontier import TOMBSTONE_SECONDS, TTL_SECONDS

#: State variables and timers need this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "url string, worker_id long, action string, outcome string, at timestamp, ord long"
SECOND = 1_000_000
#: Rows that are told at a time.
CHUNK = 20_000


def whole(text: str | None) -> int | None:
    """A number that came as text: numbers with nulls among them would come as floats."""
    return None if text is None else int(text)


class Standing:
    """A URL's lease (worker, until), its place in the queue (since) and its tombstone (until), each a tuple or None."""

    def __init__(self, lease: tuple | None, queued: tuple | None, done: tuple | None):
        self.lease, self.queued, self.done = lease, queued, done

    def settled(self, now: int) -> tuple | None:
        """Ends what has ended by now; the lease that did, which leaves its URL queued."""
        if self.done is not None and self.done[0] < now:
            self.done = None
        ended = self.lease
        if ended is None or ended[1] >= now:
            return None
        self.lease, self.queued = None, (ended[1],)
        return ended

    def judged(self, worker: int, action: str, now: int, ttl: int, tombstone: int) -> str:
        """The outcome of one request, once what has ended is settled."""
        held = self.lease
        if action in ("complete", "release"):
            if held is None or held[0] != worker:
                return "rejected"
            self.lease = None
            if action == "release":
                self.queued = (now,)
                return "requeued"
            self.done = (now + tombstone,)
            return "completed"
        if self.done is not None:
            return "tombstoned"
        if action == "enqueue":
            if held is not None or self.queued is not None:
                return "already-active"
            self.queued = (now,)
            return "queued"
        if held is not None and held[0] != worker:
            return "refused"
        if held is None and self.queued is None:
            return "absent"
        self.lease, self.queued = (worker, now + ttl), None
        return "leased" if held is None else "renewed"


class LeaseLife(StatefulProcessor):
    """Requests (url, worker_id, action, micros, ord) of one URL against its lease, its place in the queue and its tombstone.

    Every access to state asks the JVM, so it is read once and written once for all of a URL's requests in a batch.  Rows come
    and go as data frames, as turning each by itself into Python costs more than judging it."""

    def __init__(self, ttl_seconds: int, tombstone_seconds: int):
        self.ttl, self.tombstone = ttl_seconds * SECOND, tombstone_seconds * SECOND

    def init(self, handle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "worker_id long, until long")
        self.queued = handle.getValueState("queued", "since long")
        self.done = handle.getValueState("tombstone", "until long")

    def standing(self) -> Standing:
        return Standing(self.lease.get(), self.queued.get(), self.done.get())

    def keep(self, s: Standing) -> None:
        for state, value in ((self.lease, s.lease), (self.queued, s.queued), (self.done, s.done)):
            if value is None:
                state.clear()
            else:
                state.update(tuple(value))

    @staticmethod
    def out(url: str, told: list[tuple]) -> pd.DataFrame:
        """Rows (worker, action, outcome, micros, ord) of one URL; objects, so that null numbers stay what they are."""
        rows = pd.DataFrame(told, columns=["worker_id", "action", "outcome", "micros", "ord"], dtype=object)
        rows.insert(0, "url", url)
        return rows

    def armed(self, s: Standing) -> None:
        """A timer just after the end of each state that has one, and no others."""
        ends = {-(-(value[-1] + 1) // 1000) for value in (s.lease, s.done) if value is not None}
        set_ = set(self.handle.listTimers())
        for t in set_ - ends:
            self.handle.deleteTimer(t)
        for t in ends - set_:
            self.handle.registerTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        url, s, told, asked = key[0], self.standing(), [], []
        for f in rows:
            asked.extend(zip(f["micros"].astype("int64").tolist(), map(whole, f["ord"]), map(whole, f["worker_id"]), f["action"], strict=True))
        for now, ord_, worker, action in sorted(asked, key=lambda r: (r[0], r[1] is not None, r[1])):
            ended = s.settled(now)
            if ended is not None:
                told.append((ended[0], "expire", "requeued", ended[1], None))
            told.append((worker, action, s.judged(worker, action, now, self.ttl, self.tombstone), now, ord_))
            if len(told) >= CHUNK:
                yield self.out(url, told)
                told = []
        self.keep(s)
        self.armed(s)
        if told:
            yield self.out(url, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self.standing()
        ended = s.settled(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self.keep(s)
        if ended is not None:
            yield self.out(key[0], [(ended[0], "expire", "requeued", ended[1], None)])


def leases(requests: DataFrame, ttl_seconds: int = TTL_SECONDS, tombstone_seconds: int = TOMBSTONE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """What becomes of a stream of requests (url, worker_id, action, ts, ord), action enqueue, lease, complete or release: url, worker_id, action, outcome, at, ord.

    A URL is queued unless it is queued, leased or tombstoned.  A lease takes a queued URL; its worker may renew it, others are refused while it
    lives.  A completion or release counts only for the holder of a living lease: the one leaves a tombstone, for whose time the URL is refused,
    the other queues it again.  So does a lease's end (action expire, ord null), which is told as soon as the requests' own time, less
    ``late``, has passed it, or by the URL's next request.  Requests with equal times are taken by ord; those later than ``late`` are left out."""
    rows = requests.withWatermark("ts", late).select("url", F.col("worker_id").cast("string").alias("worker_id"), "action", "ts", F.unix_micros("ts").alias("micros"), F.col("ord").cast("string").alias("ord"))
    out = rows.groupBy("url").transformWithStateInPandas(LeaseLife(ttl_seconds, tombstone_seconds), OUT.replace("at timestamp", "micros long"), "Append", "EventTime")
    return out.select("url", "worker_id", "action", "outcome", F.timestamp_micros("micros").alias("at"), "ord")
