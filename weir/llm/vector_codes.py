"""Product codes of vectors with codebooks found by a VA-file search (operator 11).

Every component x becomes the integer floor(256 * x); a vector is cut into 16 equal parts, and each part is replaced by the
nearest of its codebook's 64 entries.  A codebook starts as that part of the 64 vectors with the smallest ids and follows
the means of its parts for two rounds, each one pass over the table that sends a sum and a count for each entry and
component.

The nearest entry is found as in a VA-file.  Each coordinate of the entries is quantised to 4 bits: 16 cells, between
quantiles of the entries' own values.  For each part to be coded a table holds the smallest and the largest squared
distance of its coordinates to every cell; the sums of these over an entry's cells bound its distance from below and above.
Only entries whose lower bound is no greater than the least upper bound are measured, in integers.

Defined results: a vector that is null or holds null or non-finite components is left out; vectors of another dimension have
codebooks of their own, from the smallest ids among themselves; where 16 does not divide the dimension, parts differ by one
component at most; an empty vector has the code of zeros and no error; of equal ids, the smaller vector comes first, null
ids come last; with fewer than 64 vectors there are fewer entries; an empty table gives an empty result; other columns are
ignored.  Components of 2 ** 19 or more would not leave every error a long: such a table raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.tables import Saved, small

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
CELLS = 16
#: Largest integer component: 4 * 64 * 2 ** 54 is a long.
LARGEST = 1 << 27
TILE = 2048
SALTS = 32


def cut(dim: int, parts: int) -> list[tuple[int, int]]:
    """First and last component of each part."""
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


class Cells:
    """One codebook: its entries and the cells of their coordinates."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        n, width = entries.shape
        order = np.sort(self.entries, axis=0)
        edges = order[(np.arange(1, CELLS) * n) // CELLS]
        self.cell = np.stack([np.searchsorted(edges[:, d], self.entries[:, d], side="right") for d in range(width)], axis=1) if width else np.zeros((n, 0), np.int64)
        # the range of the entries' values in each cell; an empty cell is never looked up
        self.low = np.zeros((width, CELLS), np.int64)
        self.high = np.zeros((width, CELLS), np.int64)
        for d in range(width):
            for c in np.unique(self.cell[:, d]):
                inside = self.entries[self.cell[:, d] == c, d]
                self.low[d, c], self.high[d, c] = inside.min(), inside.max()

    def candidates(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and entries, in order, that the bounds cannot tell from the nearest."""
        n = len(parts)
        lower, upper = np.zeros((n, len(self.entries)), np.int64), np.zeros((n, len(self.entries)), np.int64)
        for d in range(parts.shape[1]):
            q = parts[:, d : d + 1]
            under, over = self.low[d] - q, q - self.high[d]
            least = np.maximum(np.maximum(under, over), 0)
            most = np.maximum(-under, -over)
            lower += (least * least)[:, self.cell[:, d]]
            upper += (most * most)[:, self.cell[:, d]]
        return np.nonzero(lower <= upper.min(axis=1, keepdims=True))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry; the lower index where several are as near."""
        found, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(parts), TILE):
            tile = parts[at : at + TILE]
            row, entry = self.candidates(tile)
            gap = tile[row] - self.entries[entry]
            measured = (gap * gap).sum(axis=1)
            first = np.searchsorted(row, np.arange(len(tile)))
            best = np.minimum.reduceat(measured, first)
            hit = np.flatnonzero(measured == best[row])
            _, at_first = np.unique(row[hit], return_index=True)
            found.append(entry[hit[at_first]])
            distances.append(best)
        return np.concatenate(found), np.concatenate(distances)


def integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """The integer components of vectors of one dimension."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * SCALE)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component of {SCALE} * x beyond {LARGEST} has no code")
    return whole.astype(np.int64).reshape(len(vectors), dim)


def _sums(books: list[np.ndarray], dim: int):
    """Of each task, the count and the componentwise sums of the parts nearest to each entry."""
    spans = cut(dim, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        sums = [np.zeros_like(c.entries) for c in cells]
        counts = np.zeros((len(books), len(books[0])), np.int64)
        for batch in batches:
            rows = integers(batch.column(0), dim)
            for p, (lo, hi) in enumerate(spans):
                entry, _ = cells[p].nearest(rows[:, lo:hi])
                counts[p] += np.bincount(entry, minlength=counts.shape[1])
                np.add.at(sums[p], entry, rows[:, lo:hi])
        for p, (lo, hi) in enumerate(spans):
            used = np.flatnonzero(counts[p])
            n, width = len(used), hi - lo
            cols = [np.full(n * width, p), np.repeat(used, width), np.tile(np.arange(width), n), sums[p][used].ravel(), np.repeat(counts[p][used], width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["part", "entry", "place", "total", "n"])

    return run


def _codes(books: list[np.ndarray], dim: int):
    spans = cut(dim, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            rows = integers(batch.column(2), dim)
            codes, error = np.zeros((len(rows), len(books)), np.uint8), np.zeros(len(rows), np.int64)
            for p, (lo, hi) in enumerate(spans):
                entry, distance = cells[p].nearest(rows[:, lo:hi])
                codes[:, p] = entry
                error += distance
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Without vectors that are null or hold null or non-finite components."""
    whole = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vec_col).isNotNull() & whole)


def fit(vectors: DataFrame, dim: int, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of usable vectors of one dimension: parts arrays of entries x width integers."""
    first = vectors.orderBy(F.col(id_col).asc_nulls_last(), vec_col).select(vec_col).limit(entries).collect()
    start = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), dim)
    books = [start[:, lo:hi].copy() for lo, hi in cut(dim, parts)]
    for _ in range(rounds):
        sums = vectors.select(vec_col).mapInArrow(_sums(books, dim), "part long, entry long, place long, total long, n long")
        # at most a row for each component of each entry, whatever the number of vectors
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r.part][r.entry, r.place] = r.total // r.n
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, in decimal."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256), one for each usable vector."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part, so there are 256 entries at most")
    kinds = dict(vectors.dtypes)
    rows = usable(vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v")), "v")
    coded = None
    for (dim,) in rows.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect():
        own = rows.where(F.size("v") == dim)
        books = fit(own, dim, "vec_id", "v", parts, entries, rounds)
        found = own.mapInArrow(_codes(books, dim), f"vec_id {kinds[id_col]}, label {kinds[label_col]}, code string, error long").withColumn("codebooks_sha256", F.lit(digest(books)))
        coded = found if coded is None else coded.unionByName(found)
    if coded is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).withColumnRenamed("vec_id", id_col)
    table = Saved(coded, "codes").df
    totals = table.groupBy("label").agg(F.sum("error").alias("label_error"))
    # labels that do not fit into a broadcast are met in one of several shares, so that no common one is a task's own
    spread = totals.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    share = F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int")
    a, b = table.withColumn("share", share).alias("a"), small(spread).alias("b")
    out = a.join(b, F.col("a.label").eqNullSafe(F.col("b.label")) & (F.col("a.share") == F.col("b.share")))
    return out.select(F.col("a.vec_id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, with their errors and the codebooks' digest."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _assigned(name: str, books: str) -> str:
    return f"""{name} AS (
  SELECT r.part, r.row, min(struct_pack(d := list_sum(list_transform(list_zip(r.part_v, b.entry_v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry := b.entry)) AS best
  FROM parts r JOIN {books} b ON b.part = r.part GROUP BY ALL)"""


def _moved(name: str, assigned: str, books: str) -> str:
    return f"""{name}_means AS (
  SELECT part, entry, list(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END ORDER BY place) AS entry_v
  FROM (SELECT a.part, a.best.entry AS entry, u.place, sum(r.part_v[u.place])::BIGINT AS s, count(*) AS n
        FROM {assigned} a JOIN parts r ON r.row = a.row AND r.part = a.part, unnest(range(1, len(r.part_v) + 1)) AS u(place) GROUP BY ALL) GROUP BY ALL),
{name} AS (SELECT b.part, b.entry, coalesce(m.entry_v, b.entry_v) AS entry_v FROM {books} b LEFT JOIN {name}_means m ON m.part = b.part AND m.entry = b.entry)"""


#: For vectors of one dimension that 16 divides.
OP11_SQL = f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT row, p.part, list_slice(v, p.part * len(v) // 16 + 1, (p.part + 1) * len(v) // 16) AS part_v FROM kept, unnest(range(16)) AS p(part)),
books0 AS (SELECT part, (row - 1)::INTEGER AS entry, part_v AS entry_v FROM parts WHERE row <= 64),
{_assigned("near1", "books0")},
{_moved("books1", "near1", "books0")},
{_assigned("near2", "books1")},
{_moved("books2", "near2", "books1")},
{_assigned("near3", "books2")},
coded AS (SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near3 GROUP BY row),
told AS (SELECT sha256(string_agg(array_to_string(entry_v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books2)
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, t.codebooks_sha256
FROM kept k JOIN coded c USING (row), told t"""
