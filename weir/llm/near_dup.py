"""MinHash near-duplicate removal by a multi-index Hamming join (operator 4).

A document's set holds its distinct shingles of ``WORDS`` words (A-Z lower-cased; the whole sequence
as one shingle when there are fewer words).  Documents with equal sets form a class and are searched
as one.  A class has a signature of 48 MinHash values of 16 bits.  The signature is cut into 12 chunks
of 4 values; two signatures that differ in at most 23 values agree, by the pigeonhole principle, in all
but one value of some chunk, so every chunk is indexed four times, each time without one value: all
pairs under the distance of 24 meet in a bucket.  At the threshold of 0.75 a pair fails to meet with a
probability of 1e-7.

A bucket's members are first compared with its smallest member; once the links so found have been
contracted to components, only members of different components in one bucket are still compared.  In
small buckets these are all such pairs.  Large buckets hold classes that are much alike, yet not enough;
those that have members in common make up a crowd, whose shingle sets are compared block against block: no pair is
emitted, only links are, and blocks are bounded in members and bytes.  So no candidate link between two components is left out, and a group of n near
copies costs n comparisons.  Each link is confirmed on the two full shingle sets.

Defined results: an empty or null text has no shingles and is linked with nothing; rows with equal ids
are one node that has the links of each of its texts; a row without id has its set size, no component,
and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.tables import Saved, components, small
from weir.llm.text_hash import mix, slices, window_hashes, words_of

WORDS = 5
CHUNKS, WIDTH = 12, 4
SMALL_BUCKET = 40
HOT_BUCKET = 1_000
#: Members and bytes of a block of a crowd, but for chance and a single larger member, and members compared at once.
BLOCK, BLOCK_BYTES, TILE = 256, 16_000_000, 64
BROADCAST_IDS = 1_000_000
_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(0, 1 << 63, CHUNKS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi, buf, offsets in slices(texts):
        starts, _, hashes = words_of(buf, offsets, lower=True)
        cut = np.searchsorted(starts, offsets)
        windows = window_hashes(hashes, WORDS)
        for k in range(hi - lo):
            a, b = cut[k], cut[k + 1]
            if b - a >= WORDS:
                yield np.unique(windows[a : b - WORDS + 1])
            else:
                yield window_hashes(hashes[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """48 MinHash values of 16 bits."""
    out = np.empty(len(_MULTIPLY), np.uint64)
    for at in range(0, len(_MULTIPLY), 8):
        part = _MULTIPLY[at : at + 8, None]
        best = None
        for k in range(0, len(shingles), 1 << 16):
            low = (shingles[None, k : k + (1 << 16)] * part).min(axis=1)
            best = low if best is None else np.minimum(best, low)
        out[at : at + 8] = best
    return (mix(out) & np.uint64(0xFFFF)).astype(np.uint16)


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """For n signatures the n x 48 keys: chunk, value left out, and the other three values, packed in 54 bits."""
    s = signatures.reshape(-1, CHUNKS, WIDTH).astype(np.int64)
    keys = np.empty((len(s), CHUNKS, WIDTH), np.int64)
    for out in range(WIDTH):
        key = np.arange(CHUNKS, dtype=np.int64)[None, :] * WIDTH + out
        for v in range(WIDTH):
            if v != out:
                key = (key << 16) | s[:, :, v]
        keys[:, :, out] = key
    return keys.reshape(len(s), CHUNKS * WIDTH)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, names, signed = [], [], []
        for s in shingle_sets(batch.column(1)):
            sizes.append(len(s))
            names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            signed.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(signed, pa.binary())], names=["id", "n_shingles", "name", "sig"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            signed = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, -1)
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), CHUNKS * WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_keys(signed).ravel()), pa.array(ids)], names=["key", "id"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, text) the shingle sets, as bytes."""
    for batch in batches:
        ids = batch.column(0)
        for lo in range(0, batch.num_rows, 256):
            sets = [s.tobytes() for s in shingle_sets(batch.column(1).slice(lo, 256))]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.binary())], names=["id", "size", "shingles"])


def _between(threshold: float):
    """Of one pair of blocks of a crowd, the links between different components; the two blocks' sets meet as 0/1 matrices."""
    share = round(threshold * 10_000)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comps, block = (table.column(c).to_numpy() for c in ("id", "comp", "block"))
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        rows, columns = np.flatnonzero(block == first), np.flatnonzero(block == second)
        out: list[tuple[int, int]] = []
        for at in range(0, len(rows), TILE):
            a = rows[at : at + TILE]
            words = np.unique(np.concatenate([sets[k] for k in a]))
            x = np.zeros((len(a), len(words)), np.float32)
            for r, k in enumerate(a):
                x[r, np.searchsorted(words, sets[k])] = 1
            sizes = x.sum(axis=1)
            for by in range(0, len(columns), TILE):
                b = columns[by : by + TILE]
                y = np.zeros((len(b), len(words)), np.float32)
                for r, k in enumerate(b):
                    w = np.minimum(np.searchsorted(words, sets[k]), len(words) - 1)
                    y[r, w[words[w] == sets[k]]] = 1
                both = (x @ y.T).astype(np.int64)
                union = sizes.astype(np.int64)[:, None] + np.array([len(sets[k]) for k in b])[None, :] - both
                for r, c in np.argwhere((both > 0) & (10_000 * both >= share * union) & (comps[a][:, None] != comps[b][None, :])):
                    out.append((int(ids[a[r]]), int(ids[b[c]])))
        return pa.table({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})

    return run


def _crowds(large: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members of different components among those that large(key, id, comp) buckets hold.

    Buckets with common members make up a crowd, whose members are cut into blocks; each pair of blocks is one group of rows."""
    hub = large.groupBy("key").agg(F.min("id").alias("b"))
    together = components(large.join(hub, "key").select(F.col("id").alias("a"), "b"))
    member = large.select("id", "comp").distinct().join(together.df.select("id", F.col("comp").alias("crowd")), "id")
    # each text is cut into shingles once, however many blocks it meets
    sets = Saved(texts.join(member.select("id").distinct(), "id", "left_semi").mapInArrow(_packed, "id long, size long, shingles binary"), "crowd-sets").df
    # blocks by hash: no task sees a whole crowd
    member = member.join(sets.groupBy("id").agg(F.sum("size").alias("size")), "id")
    sizes = member.groupBy("crowd").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = member.join(sizes, "crowd").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = sent.select("crowd", "id", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return pairs.join(sets.select("id", "shingles"), "id").select("crowd", "i", "j", "id", "comp", "block", "shingles").groupBy("crowd", "i", "j").applyInArrow(_between(threshold), "a long, b long")


def _linked(threshold: float):
    share = round(threshold * 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            keep = []
            a_ids, b_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            b_texts = batch.column(3)
            for k, a in enumerate(shingle_sets(batch.column(2))):
                if last != (b_ids[k], b_texts[k]):
                    last, kept = (b_ids[k], b_texts[k]), next(iter(shingle_sets(b_texts.slice(k, 1))))
                both = len(np.intersect1d(a, kept, assume_unique=True))
                keep.append(both > 0 and 10_000 * both >= share * (len(a) + len(kept) - both))
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array([a_ids[k] for k in at], batch.column(0).type), pa.array([b_ids[k] for k in at], batch.column(0).type)], names=["a", "b"])

    return run


def _with_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows (key, …) joined to their buckets(key, n, …): very large buckets are looked up where the rows lie, so that none is a task's own."""
    hot = small(buckets.where(F.col("n") > HOT_BUCKET))
    cold = rows.join(hot.select("key"), "key", "left_anti").join(buckets.where(F.col("n") <= HOT_BUCKET), "key")
    return rows.join(hot, "key").unionByName(cold)


def near_duplicates(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id reachable over links) and kept."""
    kind = dict(docs.dtypes)[id_col]
    scratch: list[Saved] = []

    def save(df: DataFrame, name: str) -> Saved:
        """A table that is no longer needed once the components are known."""
        scratch.append(Saved(df, name))
        return scratch[-1]

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    told = Saved(texts.mapInArrow(_features, "id long, n_shingles long, name binary, sig binary"), "sets")
    named = told.df.where("id is not null and name is not null")
    classes = Saved(named.groupBy("name").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("sig").alias("sig")), "classes")
    keys = classes.df.select("id", "sig").mapInArrow(_keys, "key long, id long")
    shared = save(keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("last <> pivot").select("key", "pivot", "n"), "shared").df
    # members of buckets that more than one class has
    members = save(_with_bucket(keys, shared).select("key", "id", "pivot").distinct(), "members")

    involved = members.df.select("id").distinct()
    n = involved.count()
    needed = save(texts.join(F.broadcast(involved) if n <= BROADCAST_IDS else involved, "id", "left_semi"), "texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        """Of pairs(a, b), those whose full sets are similar enough."""
        with_a = pairs.join(needed.df.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        with_b = with_a.join(needed.df.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return with_b.select("a", "b", "text_a", "text_b").mapInArrow(_linked(threshold), "a long, b long")

    star = save(members.df.where("id <> pivot").groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("n")), "star")
    best = star.df.groupBy("id").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot"))
    # the classes of one id are linked: rows with equal ids are one node
    several = named.groupBy("id").agg(F.min("name").alias("n0"), F.max("name").alias("n1")).where("n0 <> n1").select("id")
    of_class = classes.df.select("name", F.col("id").alias("rep"))
    same = named.join(several, "id", "left_semi").join(of_class, "name").select("id", "rep")
    same = same.join(same.groupBy("id").agg(F.min("rep").alias("least")), "id").select(F.col("rep").alias("a"), F.col("least").alias("b")).where("a <> b")
    links = save(confirm(best.select(F.col("id").alias("a"), F.col("pivot").alias("b"))).union(same), "links")
    comps = components(links.df)
    def torn(of: DataFrame) -> DataFrame:
        """Rows of of(key, id, …) with comp and the bucket's size n, of the buckets with members of different components."""
        found = of.join(comps.df, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        mixed = found.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("n")).where("c0 <> c1")
        return _with_bucket(found, save(mixed.select("key", "n"), "mixed").df)

    left = save(torn(members.df), "torn")
    if not left.df.isEmpty():
        # in every pair a is greater than b, as in the first round's
        lesser = left.df.where(F.col("n") <= SMALL_BUCKET).select("key", "id", "comp")
        pairs = lesser.join(lesser.withColumnsRenamed({"id": "b", "comp": "cb"}), "key").where("id > b and comp <> cb").select(F.col("id").alias("a"), "b")
        hubs = left.df.where(F.col("n") > SMALL_BUCKET).join(comps.df.withColumnsRenamed({"id": "pivot", "comp": "cp"}), "pivot", "left").where(F.col("comp") != F.coalesce("cp", "pivot")).select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        more = pairs.union(hubs).distinct().join(best.select(F.col("id").alias("a"), F.col("pivot").alias("b")), ["a", "b"], "left_anti")
        new = save(confirm(more), "links")
        if not new.df.isEmpty():
            links = save(links.df.union(new.df), "links")
            comps = components(links.df)
        large = save(torn(left.df.where(F.col("n") > SMALL_BUCKET).select("key", "id")).select("key", "id", "comp"), "large")
        if not large.df.isEmpty():
            found = save(_crowds(large.df, needed.df, threshold), "links")
            if not found.df.isEmpty():
                links = save(links.df.union(found.df), "links")
                comps = components(links.df)
    for t in scratch:
        t.drop()
    comp_of = classes.df.join(comps.df, "id", "left").select("name", F.coalesce("comp", "id").alias("comp"))
    # equal ids are one node: their classes share their components
    first = told.df.where("id is not null").join(comp_of, "name", "left").groupBy("id").agg(F.min(F.coalesce("comp", "id")).alias("component_id"))
    out = told.df.select("id", "n_shingles").join(first, "id", "left")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", F.col("component_id").cast(kind).alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_near_dup(spark, sf_dir: str) -> DataFrame:
    """Classes of near duplicates of all documents, at a Jaccard similarity of five-word shingles of 0.75."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 0.75)
