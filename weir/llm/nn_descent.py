"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 6).

Equal vectors form one node.  The first graph links nodes that lie close in the order of random
hyperplane codes; then rounds of joins improve it: every node brings its neighbours and reverse
neighbours together, with their vectors, and each of those keeps whichever of the others is closer than
its worst neighbour so far.  Rounds go on until next to no neighbour is new.  A query walks the graph: from
its own node (or, for vectors not in the index, from the nodes next to it in the code order) it visits the
neighbours of its best nodes until all its best ``beam`` nodes have been visited.  All nodes are indexed; nothing
is collected, and only tables whose bytes have been summed and found small are broadcast.

How wide a beam has to be depends on the number of vectors and on how they lie.  So it is measured: up to
``PROBES`` of the queries, those with the smallest hashes, are also answered by brute force, in blocks over
all vectors; should the walks have found less than ``RECALL`` of those neighbours, the beam doubles, and all
queries walk on from what they have seen.  If that is still so where a wider beam would take longer than comparing
all queries with all vectors, block against block, the vectors have no structure that a graph could follow, and the
latter is done.

Lists of neighbours travel packed, one row a node and local join, and are merged by arrays.

Reverse neighbours brought together in one round are a sample of at most ``DEGREE`` by hash, as NN-descent
has it; a node of high in-degree has others in another round.  Finished rounds' shuffle files are let go.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; vectors of
each dimension are searched by themselves, as there is no cosine between two dimensions; equal vectors are
neighbours with cosine one; ties go to the smaller id; with few candidates all of them are returned; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.tables import Saved, free, small

DEGREE = 24
#: Rounds end when a smaller share than this of all neighbours is new; so many rounds at most.
SETTLED = 0.1
MOST_ROUNDS = 12
CODES = 8
CHUNK = 1024
BEAM = 144
PROBES = 64
RECALL = 0.92
WIDEST = 8192
#: A visit takes as long as so many comparisons in blocks (305 and 0.07 microseconds a core, by 4,104 queries among 205,128 vectors).
VISIT = 4096
#: Queries compared with all vectors at once.
BLOCK = 2048
ASKED = "__weir_asked"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v: array<double>) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)


def _half(column: pa.Array, rows: int | None = None) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column) if rows is None else rows, -1).astype(np.float32)


def _normalised(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(11).standard_normal((CODES, 20, dimension))
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, dimension)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
            half = v.astype(np.float16)
            bits = 1 << np.arange(19, -1, -1)
            codes = [pa.array(((v @ p.T > 0) * bits).sum(axis=1)) for p in planes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in half], pa.binary()), *codes], names=["node", "half", *(f"c{k}" for k in range(CODES))])

    return run


PACKED = "a long, b binary, sim binary"


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of the values, of the given sizes, as bytes."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _packed(ids: np.ndarray, sizes: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    """A row for each of ids that has neighbours."""
    some = np.flatnonzero(sizes)
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), _binary(b.astype(np.int64), sizes[some]), _binary(sim.astype(np.float32), sizes[some])], names=["a", "b", "sim"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours among each run of CHUNK nodes in code order; runs overlap by half."""
    for batch in batches:
        n = batch.num_rows
        if n < 2:
            continue
        ids, v = batch.column(0).to_numpy(), _half(batch.column(1))
        for a in range(0, max(1, n - CHUNK // 2), CHUNK // 2):
            yield _best(ids[a : a + CHUNK], v[a : a + CHUNK], None)


def _best(ids: np.ndarray, v: np.ndarray, worst: np.ndarray | None) -> pa.RecordBatch:
    """For each of ids its closest among the others: DEGREE of them, or half as many if closer than its worst neighbour so far."""
    sims = v @ v.T
    np.fill_diagonal(sims, -9)
    m = min(DEGREE if worst is None else DEGREE // 2, len(ids) - 1)
    top = np.argpartition(-sims, m - 1, axis=1)[:, :m] if m else np.zeros((len(ids), 0), int)
    found = np.take_along_axis(sims, top, axis=1)
    keep = np.ones_like(found, bool) if worst is None else found > worst[:, None] + 1e-4
    return _packed(ids, keep.sum(axis=1), ids[top][keep], found[keep])


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold all rows of each of their keys, from batches that come sorted by their first column."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        keys = now.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield now.slice(0, cut).combine_chunks()
        held = now.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local joins over rows (via, node, half, worst) that are sorted by via."""
    for table in _by_key(batches):
        via, ids, worst = (table.column(k).to_numpy() for k in (0, 1, 3))
        v = _half(table.column(2).combine_chunks() if table.column(2).num_chunks != 1 else table.column(2).chunk(0))
        cut = np.flatnonzero(np.r_[True, via[1:] != via[:-1], True])
        out = [_best(ids[a:b], v[a:b], worst[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1]
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def _flat(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of rows of bytes, one after another, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) for r in rows], np.int64) // np.dtype(kind).itemsize


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, sim, old), sorted by a, the DEGREE closest of each a, with its worst so far, how many there are and how many are new."""
    for table in _by_key(batches):
        a = table.column(0).to_numpy()
        (b, sizes), (sim, _) = _flat(table.column(1), np.int64), _flat(table.column(2), np.float32)
        old = np.repeat(table.column(3).to_numpy(), sizes)
        nodes, owner = np.unique(np.repeat(a, sizes), return_inverse=True)
        if not len(nodes):
            continue
        # of a neighbour met several times the closest, which tells whether it is old if any is
        by = np.lexsort((-sim, b, owner))
        owner, b, sim, old = owner[by], b[by], sim[by], old[by]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (b[1:] != b[:-1])])
        old = np.maximum.reduceat(old, first)
        owner, b, sim = owner[first], b[first], sim[first]
        by = np.lexsort((b, -sim, owner))
        place = np.arange(len(by)) - np.searchsorted(owner, np.arange(len(nodes)))[owner[by]]
        by = by[place < DEGREE]
        owner, b, sim, old = owner[by], b[by], sim[by], old[by]
        n = np.bincount(owner, minlength=len(nodes))
        last = np.cumsum(n) - 1
        worst = np.where(n >= DEGREE, sim[last], -2).astype(np.float32)
        rows = _packed(nodes, n, b, sim)
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(worst), pa.array(n), pa.array(n - np.bincount(owner, old, len(nodes)).astype(np.int64))], names=["a", "b", "sim", "worst", "n", "fresh"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            b, sizes = _flat(batch.column(1), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(b)], names=["a", "b"])


def _together(df: DataFrame) -> DataFrame:
    """A stage's partitions in two tasks a core at most: what is dealt by queries or nodes is even and small, and each task has its price."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def _top(lists: DataFrame) -> DataFrame:
    """Of rows (a, b, sim, old), old being 1 for a list of the graph so far, the graph of each node's closest."""
    return _together(lists.repartition("a").sortWithinPartitions("a").mapInArrow(_merge, PACKED + ", worst float, n long, fresh long"))


class Index:
    """Of nodes(node, v): the table (node, half, codes) and the neighbour graph (a, b, sim, worst, n, fresh), a row a node with its closest found."""

    def __init__(self, nodes: DataFrame, dimension: int):
        self.table = Saved(nodes.select("node", "v").mapInArrow(_normalised(dimension), "node long, half binary, " + ", ".join(f"c{k} long" for k in range(CODES))), "nodes")
        # so few ranges that each holds several chunks
        self.count = count = self.table.df.count()
        n = max(1, min(count // (4 * CHUNK), max(4 * self.table.spark.sparkContext.defaultParallelism, count // (64 * CHUNK))))
        parts = None
        for k in range(CODES):
            ordered = self.table.df.select("node", "half", f"c{k}").repartitionByRange(n, f"c{k}", "node").sortWithinPartitions(f"c{k}", "node")
            links = ordered.select("node", "half").mapInArrow(_close, PACKED)
            parts = links if parts is None else parts.union(links)
        self.graph = Saved(_top(parts.withColumn("old", F.lit(0))), "graph")
        self.rounds, self.buckets, self.near = 0, max(2 * self.table.spark.sparkContext.defaultParallelism, count * DEGREE * (2 * dimension + 8) // BUCKET_BYTES), None

    @property
    def edges(self) -> DataFrame:
        """Rows (a, b) of the graph."""
        return self.graph.df.select("a", "b").mapInArrow(_edges, "a long, b long")

    def wide(self) -> DataFrame:
        """Rows (node, b, halves) of the graph as it is, with the neighbours' vectors, stored in buckets by node."""
        if self.near is None:
            vectors = self.table.df.select(F.col("node").alias("b"), "half")
            rows = self.edges.join(vectors, "b").select("a", "b", "half").repartition(self.buckets, "a").sortWithinPartitions("a")
            self.near = Saved(rows.mapInArrow(_wide, "node long, b binary, halves binary"), "wide", ("node", self.buckets))
        return self.near.df

    def descend(self) -> float:
        """One round; the share of neighbours that are new."""
        if self.near is not None:
            self.near.drop()
            self.near = None
        graph, vectors, turn = self.graph, self.table.df.select("node", "half"), self.rounds
        edges = self.edges
        back = edges.select(F.col("b").alias("via"), F.col("a").alias("node"))
        r = F.row_number().over(Window.partitionBy("via").orderBy(F.xxhash64("node", F.lit(turn))))
        back = back.withColumn("r", r).where(F.col("r") <= DEGREE).drop("r")
        both = edges.select(F.col("a").alias("via"), F.col("b").alias("node")).union(back).distinct()
        known = vectors.join(graph.df.select(F.col("a").alias("node"), "worst"), "node")
        rows = both.join(known, "node").select("via", "node", "half", "worst")
        met = rows.repartition("via").sortWithinPartitions("via").mapInArrow(_meet, PACKED)
        self.graph = Saved(_top(met.withColumn("old", F.lit(0)).union(graph.df.select("a", "b", "sim", F.lit(1).alias("old")))), "graph")
        self.rounds += 1
        graph.drop()
        free(self.table.spark)
        return self.graph.df.agg(F.sum("fresh") / F.sum("n")).first()[0] or 0.0

    def settle(self, most_rounds: int = MOST_ROUNDS, settled: float = SETTLED) -> Index:
        while self.rounds < most_rounds and self.descend() > settled:
            pass
        return self


def _cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; each vector is scaled by its largest component, which keeps its squares in range."""
    scale = lambda v: F.array_max(F.transform(v, lambda x: F.abs(x)))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    whole = dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    x, y = F.transform(a, lambda p: p / scale(a)), F.transform(b, lambda p: p / scale(b))
    fits = (scale(a) < 1e100) & (scale(b) < 1e100) & (scale(a) > 1e-100) & (scale(b) > 1e-100)
    return F.when(fits, whole).otherwise(dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))))


def _half_cosine(a: Column, b: Column) -> Column:
    @F.pandas_udf("float")
    def sims(x: pd.Series, y: pd.Series) -> pd.Series:
        u, v = (np.frombuffer(b"".join(s), np.float16).reshape(len(s), -1).astype(np.float32) for s in (x, y))
        return pd.Series((u * v).sum(axis=1))

    return sims(a, b)


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (q, neighbours) the distinct pairs (q, node) of a batch."""
    for batch in batches:
        if batch.num_rows:
            b, sizes = _flat(batch.column(1), np.int64)
            pairs = np.unique(np.stack([np.repeat(batch.column(0).to_numpy(), sizes), b], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["q", "node"])


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, b, half), sorted by node, a row a node: its neighbours and their vectors, each run together."""
    for table in _by_key(batches):
        node, b = table.column(0).to_numpy(), table.column(1).to_numpy()
        nodes, sizes = np.unique(node, return_counts=True)
        half = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8).reshape(len(node), -1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), _binary(b, sizes), _runs(half, sizes)], names=["node", "b", "halves"])


def _runs(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of rows of bytes, of the given sizes, as bytes."""
    return _binary(rows.ravel(), sizes * rows.shape[1])


SEEN = "q long, half binary, ids binary, sim binary, visited binary"


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (q, half, node, its vector) walks that have met that node."""
    for batch in batches:
        sim = (_half(batch.column(1)) * _half(batch.column(3))).sum(axis=1) if batch.num_rows else np.zeros(0, np.float32)
        one = np.ones(batch.num_rows, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(batch.column(2).to_numpy(), one), _binary(sim, one), _binary(np.zeros(len(one), np.uint8), one)], names=["q", "half", "ids", "sim", "visited"])


def _fronts(beam: int):
    """Of walks, sorted by nearness, the nodes among the best beam that have not been visited, with what it takes to be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ids, sizes), (sim, _), (seen, _) = _flat(batch.column(2), np.int64), _flat(batch.column(3), np.float32), _flat(batch.column(4), np.uint8)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
            at = np.flatnonzero((place < beam) & (seen == 0))
            if not len(at):
                continue
            last = np.cumsum(sizes) - 1
            least = np.where(sizes >= 2 * beam, sim[np.maximum(last, 0)], -2).astype(np.float32) if len(sim) else np.zeros(len(sizes), np.float32)
            row = row[at]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(least[row])], names=["node", "q", "half", "least"])

    return run


#: Vectors that a query's are compared with at once.
AT_ONCE = 65_536
#: More than what half precision makes of the difference of two cosines.
ROUNDED = 0.004
#: Walks end together when a LEFT-th or less of all beams has not been visited, and nothing of each beam's best CLOSE-th.
LEFT, CLOSE = 256, 4
#: Bytes of a bucket of neighbours' vectors.
BUCKET_BYTES = 32_000_000


def _visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (q, half, least, b, halves) the neighbours b that are near enough to be kept, and how near they are."""
    for batch in batches:
        step = max(1, AT_ONCE // DEGREE)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            b, sizes = _flat(part.column(3), np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            sim = np.einsum("ij,ij->i", _half(part.column(4), len(b)), _half(part.column(1))[row])
            keep = sim >= part.column(2).to_numpy()[row]
            sizes = np.bincount(row[keep], minlength=len(sizes))
            some = np.flatnonzero(sizes)
            new = np.zeros(int(sizes.sum()), np.uint8)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.nulls(len(some), pa.binary()), _binary(b[keep], sizes[some]), _binary(sim[keep], sizes[some]), _binary(new, sizes[some])], names=["q", "half", "ids", "sim", "visited"])


def _walked(beam: int, visited: int):
    """Of rows (q, half, ids, sim, visited), sorted by q, one walk a query: its 2 * beam nearest nodes, the nearest first, and how many of the best beam have not been visited.

    Rows that hold a walk so far have a vector, those of nodes just met have none; the first ``visited`` of its nodes have been visited by now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches):
            q, half = table.column(0).to_numpy(), table.column(1)
            old = np.flatnonzero(half.is_valid().to_numpy())
            queries, at = np.unique(q[old], return_index=True)
            (ids, sizes), (sim, _) = _flat(table.column(2), np.int64), _flat(table.column(3), np.float32)
            seen = _flat(table.column(4), np.uint8)[0].copy()
            row = np.repeat(np.arange(len(q)), sizes)
            place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
            seen[half.is_valid().to_numpy()[row] & (place < visited)] = 1
            owner = np.searchsorted(queries, q)[row]
            by = np.lexsort((1 - seen, ids, owner))
            owner, ids, sim, seen = owner[by], ids[by], sim[by], seen[by]
            first = np.r_[True, (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])][: len(ids)]
            owner, ids, sim, seen = owner[first], ids[first], sim[first], seen[first]
            by = np.lexsort((ids, -sim, owner))
            owner, ids, sim, seen = owner[by], ids[by], sim[by], seen[by]
            place = np.arange(len(ids)) - np.searchsorted(owner, np.arange(len(queries)))[owner]
            open_ = (place < beam) & (seen == 0)
            front, close = (np.bincount(owner[open_ & (place < most)], minlength=len(queries)) for most in (beam, max(1, beam // CLOSE)))
            kept = place < 2 * beam
            n = np.bincount(owner[kept], minlength=len(queries))
            yield pa.RecordBatch.from_arrays([pa.array(queries), half.take(pa.array(old[at])).combine_chunks(), _binary(ids[kept], n), _binary(sim[kept], n), _binary(seen[kept], n), pa.array(front), pa.array(close)], names=["q", "half", "ids", "sim", "visited", "front", "close"])

    return run


def _nodes(k: int | None):
    """Rows (q, node, sim) of walks: of all nodes kept or, with k, of those that can be among the k nearest others for all that half precision tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(0).to_numpy()
            (ids, sizes), (sim, _) = _flat(batch.column(2), np.int64), _flat(batch.column(3), np.float32)
            row = np.repeat(np.arange(len(q)), sizes)
            if k is not None and len(row):
                start = np.cumsum(sizes) - sizes
                border = np.where(sizes > k, sim[np.minimum(start + k, len(sim) - 1)] - ROUNDED, -2)
                keep = sim >= border[row]
                row, ids, sim = row[keep], ids[keep], sim[keep]
            yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(ids), pa.array(sim)], names=["q", "node", "sim"])

    return run


def rows_of(walks: DataFrame, k: int | None = None) -> DataFrame:
    """Rows (q, node, sim) of walks."""
    return walks.mapInArrow(_nodes(k), "q long, node long, sim float")


def search(index: Index, queries: DataFrame, beam: int = BEAM, before: Saved | None = None) -> Saved:
    """Greedy walks of queries(q, half, start), a row a query with the 2 * beam nearest nodes it has met: all starts of a query are its entry points, or the walks ``before``, of half the beam, go on.

    A walk ends when all its best ``beam`` nodes have been visited, however many steps that takes.  A query visits a node by meeting the row of
    the node's neighbours and their vectors, which lie in buckets by node and are not shuffled; only neighbours nearer than the last
    of those it keeps go back to it.  A node beyond the 2 * beam nearest cannot come among them again, so it is forgotten."""
    wide = index.wide()

    def step(rows: DataFrame, visited: int) -> Saved:
        return Saved(_together(rows.repartition("q").sortWithinPartitions("q").mapInArrow(_walked(beam, visited), SEEN + ", front long, close long")), "walks")

    if before is None:
        vectors = index.table.df.select(F.col("node").alias("start"), F.col("half").alias("of"))
        walks = step(queries.join(vectors, "start").select("q", "half", "start", "of").mapInArrow(_start, SEEN), 0)
    else:
        walks = step(before.df.drop("front", "close"), 0)
        before.drop()
    while walks.df.agg((F.sum("front") > F.count(F.lit(1)) * beam / LEFT) | (F.sum("close") > 0)).first()[0]:
        fronts = walks.df.drop("front", "close").mapInArrow(_fronts(beam), "node long, q long, half binary, least float")
        met = fronts.hint("shuffle_hash").join(wide, "node").select("q", "half", "least", "b", "halves").mapInArrow(_visit, SEEN)
        new = step(walks.df.drop("front", "close").union(met), beam)
        walks.drop()
        walks = new
        free(index.table.spark)
    return walks


def _brute(sent, k: int):
    """Of each block of (node, half) the k closest to each query, as rows (q, node, sim)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = sent.value
        v = v.astype(np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(0).to_numpy()
            sims = v @ _half(batch.column(1)).T
            sims[ids[:, None] == nodes[None, :]] = -9
            m = min(k, len(nodes))
            top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(nodes[top].ravel()), pa.array(np.take_along_axis(sims, top, axis=1).ravel())], names=["q", "node", "sim"])

    return run


def _closest(rows: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "node"))
    return rows.where("q <> node").withColumn("r", r).where(F.col("r") <= k).select("q", "node", "sim")


def probed(index: Index, queries: DataFrame, k: int, probes: int = PROBES) -> dict[int, tuple[float, int]]:
    """For a few of the queries, by brute force: how close the k-th nearest node is, and how many there are."""
    asked = queries.select("q", "half").distinct().orderBy(F.xxhash64("q"), "q").limit(probes).collect()
    if not asked:
        return {}
    sent = index.table.spark.sparkContext.broadcast((np.array([r["q"] for r in asked]), np.frombuffer(b"".join(r["half"] for r in asked), np.float16).reshape(len(asked), -1)))
    rows = index.table.df.select("node", "half").mapInArrow(_brute(sent, k), "q long, node long, sim float")
    return {r["q"]: (r["least"] - 1e-4, r["n"]) for r in _closest(rows, k).groupBy("q").agg(F.min("sim").alias("least"), F.count(F.lit(1)).alias("n")).collect()}


def compared(index: Index, queries: DataFrame, k: int, block: int = BLOCK) -> Saved:
    """Rows (q, node, sim) of each query's k closest nodes, by brute force: each block of queries against all nodes."""
    asked = Saved(queries.select("q", "half").distinct().withColumn("block", F.pmod(F.xxhash64("q"), F.lit(max(1, queries.count() // block)))), "blocks")
    found = None
    for (b,) in asked.df.select("block").distinct().orderBy("block").collect():
        own = asked.df.where(F.col("block") == b).collect()
        sent = index.table.spark.sparkContext.broadcast((np.array([r["q"] for r in own]), np.frombuffer(b"".join(r["half"] for r in own), np.float16).reshape(len(own), -1)))
        rows = Saved(_closest(index.table.df.select("node", "half").mapInArrow(_brute(sent, k), "q long, node long, sim float"), k), "compared").df
        found = rows if found is None else found.unionByName(rows)
    return Saved(found, "compared")


def recall(seen: DataFrame, truth: dict[int, tuple[float, int]], k: int) -> float:
    """The share of the probes' nearest nodes that were seen; what is as close as the k-th counts, so ties do no harm."""
    total = sum(n for _, n in truth.values())
    if not total:
        return 1.0
    rows = _closest(seen.where(F.col("q").isin(list(truth))), k).collect()
    return sum(r["sim"] >= truth[r["q"]][0] for r in rows) / total


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """For each row of vectors that is_query holds for, its k nearest other rows by cosine: query_id, rank, vec_id, score."""
    marked = vectors.withColumn(ASKED, F.coalesce(is_query, F.lit(False)))
    rows = usable(vectors, id_col, vector_col)
    asked = marked.where(ASKED).select(F.col(id_col).cast("long").alias("id")).distinct()
    found = [_nearest(rows.where(F.size("v") == d), asked, d, k, most_rounds) for (d,) in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    if not found:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _nearest(rows: DataFrame, asked: DataFrame, dimension: int, k: int, most_rounds: int) -> DataFrame:
    """nearest() among rows(id, v) of one dimension, for those whose id is asked(id)."""
    classes = Saved(rows.groupBy("v").agg(F.min("id").alias("node")), "classes")
    index = Index(classes.df, dimension).settle(most_rounds)
    members = Saved(rows.join(classes.df, "v").select("node", "id").distinct(), "members")
    wanted = Saved(members.df.join(asked, "id").select("node", F.col("id").alias("query_id")), "wanted")
    q = Saved(wanted.df.select("node").distinct().join(index.table.df, "node").select(F.col("node").alias("q"), "half", F.col("node").alias("start")), "queries").df
    truth, beam = probed(index, q, k), BEAM
    seen = search(index, q, beam)
    while recall(rows_of(seen.df.where(F.col("q").isin(list(truth)))), truth, k) < RECALL:
        if beam >= WIDEST or beam * VISIT > index.count:
            seen.drop()
            found = compared(index, q, 2 * k).df
            break
        beam *= 2
        seen = search(index, q, beam, seen)
    else:
        found = rows_of(seen.df, k)
    near = found.select("q", "node").union(q.select("q", F.col("q").alias("node"))).distinct()
    a, b = classes.df.select(F.col("node").alias("q"), F.col("v").alias("x")), classes.df.select("node", F.col("v").alias("y"))
    scored = near.join(b, "node").join(a, "q").select("q", "node", _cosine(F.col("x"), F.col("y")).alias("score"))
    # of a node's equal vectors the k + 1 smallest ids can be among the k nearest of a query; in two steps, as one vector may be very common
    some = F.row_number().over(Window.partitionBy("node", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))
    n = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    few = members.df.withColumn("n", some).where(F.col("n") <= k + 1).withColumn("n", n).where(F.col("n") <= k + 1).select("node", F.col("id").alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    lists = scored.join(few, "node").withColumn("n", best).where(F.col("n") <= k + 1).select("q", "vec_id", "score")
    hits = wanted.df.withColumnRenamed("node", "q").join(lists, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nn_descent(spark, sf_dir: str) -> DataFrame:
    """The five nearest rows of embeddings for every row whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 50 == 0)
