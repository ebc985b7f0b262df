"""Mergeable quantile summaries: q-digests (operator 13).

A summary of integers x holds counts of nodes of the binary trie over them: node (level, pos) stands for all x with
x >> level = pos.  A summary of up to ``MOST`` rows holds its leaves.  A larger one is compressed bottom-up: a node takes in all
below it while these are together no more than ``BATCH_SHARE`` of the rows and a twentieth of the different x, so that every x is
known to within one node of its path.  The smallest and the largest x are points of their own.  What would still exceed the
budget of points is pruned: nodes are folded into their parents, those first whose counts widen the rank intervals below the least.

Summaries are merged by adding nodes with equal places, and the sum is compressed again, by ``WHOLE_SHARE`` of its rows, and
pruned.  The rank of x then lies between the counts of all nodes that end at x or before and these with the counts of the nodes
around x, which are no more than both shares of the rows together.  The answer to a rank is the end of the first node, in the order
of their ends and small nodes first, up to which enough rows are counted; it is kept within the smallest and the largest x.

Counting, adding, asking and the exact ranks are aggregates, joins and windows of bounded length.  Compression runs in tasks by
trie: first all leaves below one node of level ``STEP``, which are 2 ** ``STEP`` at most, then what is left of a summary, so the rows
of one group are never in one task.

Defined results: rows without a group or money, or with money that isn't finite, are dropped; rows without an id are in batch 0; of
clicks with one id (or none) the first to arrive counts; of items with one id the smallest brand and price; an empty table gives an
empty result; repeated rows of other tables count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.tables import Saved

BATCHES = 16
#: Least and most points of a summary, and parts into which its ranks are cut.
LEAST, MOST, PARTS = 200 // 10, 20_000 // 10, 20
#: A node takes in no more than one row in so many.
BATCH_SHARE, WHOLE_SHARE = 400, 200
STEP = 14
TOP = 62
KEYS = ["stream", "grp", "batch"]
NODES = [*KEYS, "level", "pos", "c"]


def merged_nodes(level: np.ndarray, pos: np.ndarray, c: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
    """The nodes by place, those of equal places added."""
    order = np.lexsort((pos, level))
    level, pos, c, m = level[order], pos[order], c[order], m[order]
    first = np.flatnonzero(np.concatenate([[True], (level[1:] != level[:-1]) | (pos[1:] != pos[:-1])])) if len(level) else np.zeros(0, np.int64)
    return level[first], pos[first], np.add.reduceat(c, first) if len(first) else c, np.add.reduceat(m, first) if len(first) else m


def compressed(level: np.ndarray, pos: np.ndarray, c: np.ndarray, m: np.ndarray, top: int, most: int, most_leaves: int) -> tuple[np.ndarray, ...]:
    """Nodes of which each has taken in all below it that are together at most most rows and most_leaves leaves."""
    level, pos, c, m = merged_nodes(level, pos, c, m)
    out: list[tuple[np.ndarray, ...]] = []
    # nodes of the level, whether all below them is taken in, and then the place, rows and leaves of what they hold
    at, whole, depth, place, held, leaves = (np.zeros(0, k) for k in (np.int64, bool, np.int64, np.int64, np.int64, np.int64))
    upmost = int(level.max(initial=0))
    for now in range(top + 1):
        if now > upmost and len(at) <= 1:
            break
        own = level == now
        p, of = np.unique(np.concatenate([at >> 1, pos[own]]), return_inverse=True)
        child, mine = of[: len(at)], of[len(at) :]
        n = np.bincount(child, minlength=len(p))
        here, total, below, takes = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.ones(len(p), bool)
        here[mine] = c[own]
        total[mine], below[mine] = c[own], m[own]
        np.add.at(total, child, held)
        np.add.at(below, child, leaves)
        np.logical_and.at(takes, child, whole)
        # a node with nothing of its own and one child is no wider than the child
        single = (n == 1) & (here == 0)
        takes &= (n == 0) | single | (total <= most) & (below <= most_leaves)
        stay = np.flatnonzero(~takes[child] & whole)
        out.append((depth[stay], place[stay], held[stay], leaves[stay]))
        alone = np.flatnonzero(~takes & (here > 0))
        out.append((np.full(len(alone), now), p[alone], here[alone], np.zeros(len(alone), np.int64)))
        deeper, wider = np.full(len(p), now), p.copy()
        lone = single[child]
        deeper[child[lone]], wider[child[lone]] = depth[lone], place[lone]
        at, whole, depth, place, held, leaves = p, takes, deeper, wider, np.where(takes, total, 0), np.where(takes, below, 0)
    out.append((depth[whole], place[whole], held[whole], leaves[whole]))
    rest = level > top
    out.append((level[rest], pos[rest], c[rest], m[rest]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pruned(level: np.ndarray, pos: np.ndarray, c: np.ndarray, m: np.ndarray, budget: int, most: int) -> tuple[np.ndarray, ...]:
    """At most budget nodes: the lightest are folded into their parents, which widens the rank intervals of what is left below by their counts."""
    level, pos, c, m = merged_nodes(level, pos, c, m)
    most = max(1, most)
    while len(level) > budget:
        for now in range(TOP):
            own, above = np.flatnonzero(level == now), np.flatnonzero(level == now + 1)
            if not len(own):
                continue
            p, first = np.unique(np.concatenate([pos[own] >> 1, pos[above]]), return_inverse=True)
            total, n = np.zeros(len(p), np.int64), np.bincount(first, minlength=len(p))
            np.add.at(total, first, np.concatenate([c[own], c[above]]))
            light = np.flatnonzero((total <= most) & (np.bincount(first[: len(own)], minlength=len(p)) > 0))
            light = light[np.argsort(total[light], kind="stable")]
            # no more than it takes
            saved = np.cumsum(n[light] - 1)
            light = light[: int(np.searchsorted(saved, len(level) - budget)) + 1]
            fold = own[np.isin(first[: len(own)], light)]
            level[fold], pos[fold] = now + 1, pos[fold] >> 1
            level, pos, c, m = merged_nodes(level, pos, c, m)
            if len(level) <= budget:
                break
        most *= 2
    return level, pos, c, m


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(table.column(k).to_numpy().astype(np.int64) for k in ("level", "pos", "c", "m"))


def _table(table: pa.Table, nodes: tuple[np.ndarray, ...], more: tuple[str, ...] = ()) -> pa.Table:
    """Nodes with the keys of the group."""
    n = len(nodes[0])
    keys = {k: pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in (*KEYS, *more)}
    return pa.table({**keys, "level": pa.array(nodes[0], pa.int32()), "pos": pa.array(nodes[1], pa.int64()), "c": pa.array(nodes[2], pa.int64()), "m": pa.array(nodes[3], pa.int64())})


def _below(top: int):
    """The nodes below one of level top, compressed."""

    def run(table: pa.Table) -> pa.Table:
        return _table(table, compressed(*_columns(table), top, table.column("n")[0].as_py() // BATCH_SHARE, table.column("most_leaves")[0].as_py()), ("n", "most_leaves"))

    return run


def _batch(table: pa.Table) -> pa.Table:
    """All that is left of a batch, compressed and pruned."""
    most = table.column("n")[0].as_py() // BATCH_SHARE
    nodes = compressed(*_columns(table), TOP, most, table.column("most_leaves")[0].as_py())
    return _table(table, pruned(*nodes, MOST - 2, most))


def _whole(table: pa.Table) -> pa.Table:
    """The sum of a group's batches, compressed and pruned; it keeps as many points as it has to."""
    most, given = table.column("n")[0].as_py() // WHOLE_SHARE, _columns(table)
    while True:
        nodes = compressed(*given, TOP, most, 1 << 62)
        if len(nodes[0]) >= min(LEAST, len(given[0])) or not most:
            return _table(table, pruned(*nodes, MOST - 2, most))
        most //= 2


KEY_TYPE, PLACE_TYPE = "stream string, grp string, batch int", "level int, pos long, c long, m long"


def batch_of(number: str) -> Column:
    """The batch of a row by its id."""
    return F.pmod(F.crc32(F.coalesce(F.col(number).cast("string"), F.lit(""))), F.lit(BATCHES)).cast("int")


def money_rows(df: DataFrame, stream: str, grp: Column, batch: Column, money: Column, n: Column) -> DataFrame:
    """Rows (stream, grp, batch, x, c) of the rows that have a group and money."""
    rows = df.select(F.lit(stream).alias("stream"), grp.cast("string").alias("grp"), batch.alias("batch"), money.cast("double").alias("money"), n.alias("c"))
    fine = F.col("grp").isNotNull() & F.col("money").isNotNull() & ~F.isnan("money") & (F.abs("money") < float("inf"))
    return rows.where(fine).select("stream", "grp", "batch", (F.floor(F.col("money") * 100 + 0.5) + 1000 * F.col("batch")).cast("long").alias("x"), "c")


def sizes_of(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes (stream, grp, batch, n, leaves, lo, hi) of all batches and groups (batch -1) of counts(stream, grp, batch, x, c); and those of more than MOST rows alone."""
    batches = counts.groupBy(*KEYS).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("leaves"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    batches = Saved(batches, "sizes").df
    wholes = batches.groupBy("stream", "grp").agg(F.sum("n").alias("n"), F.sum("leaves").alias("leaves"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("batch", F.lit(-1))
    sizes = Saved(batches.unionByName(wholes), "sizes").df
    # a table of its own, so that joins know how small it is
    return sizes, Saved(sizes.where(F.col("n") > MOST), "large-sizes").df


def digests(counts: DataFrame, large: DataFrame) -> DataFrame:
    """Nodes (stream, grp, batch, level, pos, c) of the summaries of all batches and, merged from these, of all groups (batch -1)."""
    batches = large.where("batch >= 0").select(*KEYS, "n", "lo", "hi", F.greatest(F.lit(1), F.floor(F.col("leaves") / LEAST)).alias("most_leaves"))
    widest = batches.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    leaf = counts.withColumn("level", F.lit(0)).withColumnRenamed("x", "pos")
    nodes = leaf.select(*NODES)
    if widest is not None:
        of = leaf.join(batches, KEYS, "left")
        alone = F.col("n").isNull() | (F.col("pos") == F.col("lo")) | (F.col("pos") == F.col("hi"))
        inner = of.where(~alone).select(*KEYS, "n", "most_leaves", "level", "pos", "c", F.lit(1).cast("long").alias("m"))
        top = 0
        while top + STEP < TOP and not (top and widest >> top < 1 << STEP):
            top += STEP
            below = F.expr(f"shiftright(pos, {top} - level)")
            inner = inner.groupBy(*KEYS, below.alias("under")).applyInArrow(_below(top), f"{KEY_TYPE}, n long, most_leaves long, {PLACE_TYPE}")
        nodes = of.where(alone).select(*NODES).unionByName(inner.groupBy(*KEYS).applyInArrow(_batch, f"{KEY_TYPE}, {PLACE_TYPE}").select(*NODES))
    nodes = Saved(nodes, "digests").df
    added = nodes.groupBy("stream", "grp", "level", "pos").agg(F.sum("c").alias("c")).withColumn("batch", F.lit(-1))
    of = added.join(large.where("batch = -1").select("stream", "grp", "n", "lo", "hi"), ["stream", "grp"], "left")
    alone = F.col("n").isNull() | (F.col("level") == 0) & ((F.col("pos") == F.col("lo")) | (F.col("pos") == F.col("hi")))
    inner = of.where(~alone).select(*KEYS, "n", "level", "pos", "c", F.lit(0).cast("long").alias("m"))
    merged = of.where(alone).select(*NODES).unionByName(inner.groupBy(*KEYS).applyInArrow(_whole, f"{KEY_TYPE}, {PLACE_TYPE}").select(*NODES))
    return nodes.unionByName(merged)


def _ranks(before: str, upto: str) -> tuple[Column, Column]:
    """First and last i of PARTS whose target lies above before and is at most upto."""
    first = F.floor(F.col(before) * PARTS / F.col("n")) + 1
    last = F.least(F.floor(F.col(upto) * PARTS / F.col("n")), F.lit(PARTS - 1))
    return first.cast("int"), last.cast("int")


def answers(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """What summaries of enough rows answer: (stream, grp, batch, n, points, i, answer), and the rows before and up to the node that does (before, upto)."""
    of = nodes.join(sizes.where(F.col("n") >= PARTS).select(*KEYS, "n", "lo", "hi"), KEYS).withColumn("end", F.expr("shiftleft(pos + 1, level) - 1"))
    # a summary has MOST nodes at most
    one = Window.partitionBy(*KEYS)
    told = of.withColumn("upto", F.sum("c").over(one.orderBy("end", "level", "pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("points", F.count(F.lit(1)).over(one))
    first, last = _ranks("before", "upto")
    told = told.withColumn("before", F.col("upto") - F.col("c")).where(first <= last)
    return told.select(*KEYS, "n", "points", F.explode(F.sequence(first, last)).alias("i"), F.least(F.greatest("end", "lo"), F.col("hi")).alias("answer"), "before", "upto")


def exact(asked: DataFrame, counts: DataFrame, large: DataFrame) -> DataFrame:
    """Rows (stream, grp, batch, n, i, exact_x, points, answer, n_below, n_upto) of large summaries' answers, from counts(stream, grp, batch, x, c).

    Ranks are found from the top of the trie down: counts of nodes STEP levels apart are summed up from left to right below one parent
    at a time, and only nodes with an answer or a wanted rank are opened."""
    widest = large.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    of = large.select(*KEYS, "n")
    batches = counts.join(of.where("batch >= 0").select(*KEYS), KEYS, "left_semi")
    wholes = counts.join(of.where("batch = -1").select("stream", "grp"), ["stream", "grp"], "left_semi").groupBy("stream", "grp", "x").agg(F.sum("c").alias("c")).withColumn("batch", F.lit(-1))
    rows = batches.unionByName(wholes).select(*KEYS, F.col("x").alias("v"), "c", F.lit(0).alias("i"), F.lit(0).cast("long").alias("points"))
    steps = [rows.unionByName(asked.select(*KEYS, F.col("answer").alias("v"), F.lit(0).cast("long").alias("c"), "i", "points"))]
    while len(steps) == 1 or widest >> STEP * (len(steps) - 1) >= 1 << STEP:
        up = steps[-1].groupBy(*KEYS, F.expr(f"shiftright(v, {STEP})").alias("v")).agg(F.sum("c").alias("c"), F.max("i").alias("i"))
        steps.append(up)
    top = steps.pop().join(of, KEYS).withColumn("base", F.lit(0).cast("long")).withColumn("parent", F.lit(0).cast("long"))
    while True:
        under = Window.partitionBy(*KEYS, "parent").orderBy("v")
        below = F.coalesce(F.sum("c").over(under.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = top.withColumn("upto", F.col("base") + F.sum("c").over(under.rangeBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("base") + below)
        first, last = _ranks("before", "upto")
        wanted = ranked.withColumn("first", first).withColumn("last", last).where("i > 0 OR first <= last")
        if not steps:
            break
        opened = wanted.select(*KEYS, "n", F.col("v").alias("parent"), F.col("before").alias("base"))
        top = steps.pop().withColumn("parent", F.expr(f"shiftright(v, {STEP})")).join(opened, [*KEYS, "parent"])
    found = wanted.where("i = 0").select(*KEYS, "n", F.explode(F.sequence("first", "last")).alias("i"), F.struct(F.col("v").alias("exact_x")).alias("e"), F.lit(None).cast("struct<points:bigint,answer:bigint,n_below:bigint,n_upto:bigint>").alias("a"))
    told = wanted.where("i > 0").select(*KEYS, "n", "i", F.lit(None).cast("struct<exact_x:bigint>").alias("e"), F.struct("points", F.col("v").alias("answer"), F.col("before").alias("n_below"), F.col("upto").alias("n_upto")).alias("a"))
    return found.unionByName(told).groupBy(*KEYS, "n", "i").agg(F.max("e.exact_x").alias("exact_x"), *[F.max(f"a.{k}").alias(k) for k in ("points", "answer", "n_below", "n_upto")])


def summarised(rows: DataFrame) -> DataFrame:
    """Answers and exact ranks of the summaries of rows (stream, grp, batch, x, c)."""
    counts = Saved(rows.groupBy(*KEYS, "x").agg(F.sum("c").cast("long").alias("c")), "counts").df
    sizes, large = sizes_of(counts)
    asked = Saved(answers(digests(counts, large), sizes), "answers").df
    # the leaves of a summary of up to MOST rows are the counts of its rows
    leaves = asked.where(F.col("n") <= MOST).select(*KEYS, "n", "i", F.col("answer").alias("exact_x"), "points", "answer", F.col("before").alias("n_below"), F.col("upto").alias("n_upto"))
    both = leaves.unionByName(exact(asked.where(F.col("n") > MOST), counts, large)).withColumn("target", F.ceil(F.col("i") * F.col("n") / PARTS).cast("long"))
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    out = both.withColumn("rank_error", error)
    return out.select(*KEYS, "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", (1000 * F.col("rank_error") <= 10 * F.col("n")).alias("within"))


def op13_quantiles(spark, sf_dir: str) -> DataFrame:
    """Quantiles of the value of clicks by client and of the price of sale lines by brand, from merged q-digests, against the exact ones."""
    clicks, lines, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clicks", "sale_lines", "items"))
    once = clicks.groupBy("click_id").agg(F.min(F.struct("arrived_at", "ts", "client_id", "value")).alias("r"))
    value = money_rows(once, "value", F.col("r.client_id"), batch_of("click_id"), F.col("r.value"), F.lit(1).cast("long"))
    # lines are counted before they meet their items, so that a common item is a few rows
    sold = lines.where("item_id IS NOT NULL").groupBy("item_id", batch_of("vendor_id").alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    priced = items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min(F.struct("brand", "price")).alias("item"))
    price = money_rows(sold.join(priced, "item_id"), "price", F.col("item.brand"), F.col("batch"), F.col("item.price"), F.col("n"))
    return summarised(value.unionByName(price))
