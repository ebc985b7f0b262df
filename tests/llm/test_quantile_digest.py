"""q-digests: exact columns against plain Python, bounds on points and ranks, and the shape of summaries."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from weir.llm import quantile_digest as qd


def plain(values):
    """{(stream, grp, batch, i): (n, target, exact_x)} and the sorted x of each summary, of rows (stream, grp, id, money)."""
    xs = defaultdict(list)
    for stream, grp, number, money in values:
        if grp is None or money is None or not math.isfinite(money):
            continue
        batch = zlib.crc32((str(number) if number is not None else "").encode()) % 16
        x = math.floor(100 * money + 0.5) + 1000 * batch
        xs[stream, str(grp), batch].append(x)
        xs[stream, str(grp), -1].append(x)
    out = {}
    for key, x in xs.items():
        x.sort()
        for i in range(1, 20) if len(x) >= 20 else ():
            target = -(-i * len(x) // 20)
            out[*key, i] = (len(x), target, x[target - 1])
    return out, xs


def holds(rows, values):
    want, xs = plain(values)
    assert {(r.stream, r.grp, r.batch, r.i): (r.n, r.target, r.exact_x) for r in rows} == want
    assert len(rows) == len(want)
    last = {}
    for r in sorted(rows, key=lambda r: r.i):
        x = np.array(xs[r.stream, r.grp, r.batch])
        key = (r.stream, r.grp, r.batch)
        assert min(20, len(set(x.tolist()))) <= r.points <= min(r.n, 2000)
        assert x[0] <= r.answer <= x[-1] and r.answer >= last.get(key, r.answer)
        last[key] = r.answer
        assert (r.n_below, r.n_upto) == ((x < r.answer).sum(), (x <= r.answer).sum())
        assert r.rank_error == max(0, r.n_below + 1 - r.target, r.target - r.n_upto)
        assert r.within and 1000 * r.rank_error <= 10 * r.n


def given(spark, values):
    df = spark.createDataFrame([(*v, 1) for v in values], "stream string, grp string, id long, money double, n long")
    parts = [qd.money_rows(df.where(df.stream == s), s, qd.F.col("grp"), qd.batch_of("id"), qd.F.col("money"), qd.F.col("n")) for s in ("value", "price")]
    return qd.summarised(parts[0].unionByName(parts[1]))


def test_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    clicks = {r.click_id: r for r in spark.read.parquet(f"{sf}/clicks.parquet").collect()}
    items = {r.item_id: r for r in spark.read.parquet(f"{sf}/items.parquet").collect()}
    values = [("value", r.client_id, r.click_id, r.value) for r in clicks.values()]
    values += [("price", items[r.item_id].brand, r.vendor_id, items[r.item_id].price) for r in spark.read.parquet(f"{sf}/sale_lines.parquet").collect() if r.item_id in items]
    rows = qd.op13_quantiles(spark, sf).collect()
    holds(rows, values)
    assert max(r.rank_error for r in rows) > 0


def shapes():
    rng = np.random.default_rng(8)
    yield "even", rng.integers(0, 3_000_000, 60_000) / 100
    yield "heavy", np.where(rng.random(50_000) < 0.98, 7.0, rng.integers(-500_000, 500_000, 50_000) / 100)
    yield "far", rng.lognormal(2, 4, 40_000) * 100 - 300
    yield "near", np.arange(45_000) % 23 / 100
    yield "wide", rng.choice([-1.0, 1.0], 20_000) * 10.0 ** rng.uniform(0, 12, 20_000)
    yield "same", np.full(30_000, 12.34)


@pytest.mark.parametrize("step", [14, 3])
def test_shapes(spark, monkeypatch, step):
    monkeypatch.setattr(qd, "STEP", step)
    values = [("value", name, int(k % 1000), float(v)) for name, money in shapes() for k, v in enumerate(money[:: 1 if step == 14 else 8])]
    holds(given(spark, values).collect(), values)


def test_nulls_repeated_and_few_rows(spark):
    values = [("price", "a", k % 3, k / 7) for k in range(70)] + [("price", "b", None, 1.0)] * 30 + [("value", "c", k, -1.5) for k in range(19)] + [("value", "d", 5, 2.5)] * 20
    odd = [("price", None, 1, 1.0), ("price", "a", 1, None), ("value", "a", 1, math.nan), ("value", "a", 2, math.inf)]
    holds(given(spark, values + odd).collect(), values + odd)
    assert given(spark, values).where("false").columns == ["stream", "grp", "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within"]
    empty = spark.createDataFrame([], "stream string, grp string, batch int, x long, c long")
    assert qd.summarised(empty).count() == 0


def digest(x, share=400):
    x, c = np.unique(x, return_counts=True)
    m = np.ones(len(x), np.int64)
    return qd.compressed(np.zeros(len(x), np.int64), x, c, m, qd.TOP, int(c.sum()) // share, 1 << 40), (x, c)


def test_compression_keeps_counts_and_bounds_nodes():
    for _, money in shapes():
        (level, pos, c, m), (x, count) = digest(np.floor(100 * money).astype(np.int64))
        assert c.sum() == count.sum() and m.sum() == len(x)
        assert (c[level > 0] <= count.sum() // 400).all()
        # no two nodes share an x, and each holds just the rows of its x
        low, high = pos << level, ((pos + 1) << level) - 1
        order = np.argsort(low)
        assert (low[order][1:] > high[order][:-1]).all()
        totals = np.concatenate([[0], np.cumsum(count)])
        assert (c == totals[np.searchsorted(x, high, side="right")] - totals[np.searchsorted(x, low)]).all()


def test_pruning_meets_its_budget_and_keeps_counts():
    rng = np.random.default_rng(9)
    (level, pos, c, m), _ = digest(rng.integers(0, 1 << 30, 9000), share=9001)
    assert len(level) > 8000
    for budget in (5000, 1998, 60):
        less = qd.pruned(level, pos, c, m, budget, 1)
        assert 0.8 * budget <= len(less[0]) <= budget and less[2].sum() == c.sum()


def test_merging_adds_nodes(spark):
    """A whole made of batches has all their rows, and its nodes are within both shares of its rows."""
    rng = np.random.default_rng(10)
    rows = [("value", "g", int(b), int(x), 1) for b in range(16) for x in rng.integers(0, 200_000, 3000)]
    counts = spark.createDataFrame(rows, "stream string, grp string, batch int, x long, c long").groupBy(*qd.KEYS, "x").agg(qd.F.sum("c").alias("c"))
    sizes, large = qd.sizes_of(counts)
    nodes = qd.digests(counts, large)
    by = {r.batch: r for r in nodes.groupBy("batch").agg(qd.F.sum("c").alias("n"), qd.F.count("*").alias("points"), qd.F.max(qd.F.expr("if(level > 0, c, 0)")).alias("most")).collect()}
    assert by[-1].n == 48_000 and all(by[b].n == 3000 for b in range(16))
    assert all(by[b].most <= 3000 // 400 and by[b].points <= 2000 for b in range(16))
    assert by[-1].most <= 48_000 // 200 + 48_000 // 400 and by[-1].points <= 2000
    assert {r.batch: r.n for r in sizes.collect()} == {b: r.n for b, r in by.items()}
