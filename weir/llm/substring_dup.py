"""Removal of long repeated passages by fixed-block anchors (operator 7).

Words are white-space words, unchanged.  A window of 35 words that also starts elsewhere holds, in each
document that has it, one of the blocks of 18 words that lie end to end from the document's start.  So
blocks are indexed, every rolling run of 18 words probes them, and a hash that is a block and occurs at
two places anchors all its places.  Anchors extend to the windows around them; a window counted at two
places is repeated, and consecutive repeated windows make up the maximal exact repeats.  Anchors only say where
to look; what is removed is decided by a window's 64-bit hash together with a second one of 31 bits, taken from
its words apart, so that among 1e12 windows two different ones agree in both with a probability of 1e-4.

Rolling hashes travel packed: texts are taken in slices of a few megabytes, and each slice sends every
hash range one row of 4-byte hashes with their positions as gaps, five to six bytes a window, whatever the
number of machines.  The number of ranges grows with the input, so that each fits in one task.  A passage
that a third of all documents share costs one entry in each place it stands: nothing is paired, and windows
that stand in more than ``HOT`` places are looked up apart, where they lie, if they are few enough to broadcast.

Defined results: a null or empty text has no words; a text of fewer than 35 words loses none; repeated rows
are places of their own, so they remove each other; null ids are ids like any other; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.tables import BROADCAST_BYTES, Saved, small
from weir.llm.text_hash import mix, slices, window_hashes, words_of

WINDOW = 35
RANGE_BYTES = 12_000_000
HOT = 2_000
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def _pack_gaps(at: np.ndarray) -> bytes:
    """Ascending positions as gaps, one, two or four bytes each; the first byte says how many."""
    gaps = np.diff(at, prepend=0)
    most = int(gaps.max()) if len(gaps) else 0
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + gaps.astype(kind).tobytes()


def _unpack_gaps(data: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[data[0]]
    return np.cumsum(np.frombuffer(data, kind, offset=1).astype(np.int64))


PACKED = "bucket long, slice long, hashes binary, gaps binary, blocks binary"


def _pack(block: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in slices(batch.column(1)):
                starts, _, words = words_of(buf, offsets, lower=False)
                cut = np.searchsorted(starts, offsets)
                if len(words) < block:
                    continue
                hashes = window_hashes(words, block)
                at = np.arange(len(hashes))
                doc = np.searchsorted(cut, at, side="right") - 1
                inside = at + block <= cut[doc + 1]
                hashes, at, doc = hashes[inside], at[inside], doc[inside]
                aligned = (at - cut[doc]) % block == 0
                name = int.from_bytes(hashlib.blake2b(keys[lo:hi].tobytes() + cut.tobytes(), digest_size=8).digest(), "big", signed=True)
                bucket = (hashes >> np.uint64(32)) % np.uint64(ranges)
                by = np.argsort(bucket, kind="stable")
                bucket, low, at, aligned = bucket[by], (hashes[by] & np.uint64(0xFFFFFFFF)).astype(np.uint32), at[by], aligned[by]
                bounds = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
                rows = [(int(bucket[a]), name, low[a:b].tobytes(), _pack_gaps(at[a:b]), np.packbits(aligned[a:b]).tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                # where each text begins, for the way back
                rows.append((name % ranges, name, keys[lo:hi].astype(np.int64).tobytes(), cut.astype(np.int64).tobytes(), None))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "slice", "hashes", "gaps", "blocks"])

    return run


def _probe(table: pa.Table) -> pa.Table:
    """Of one hash range: the anchored positions of each slice (keys null), and the slices' own rows as they came."""
    names, packed, gaps, blocks = (table.column(c).to_pylist() for c in ("slice", "hashes", "gaps", "blocks"))
    real = [k for k, b in enumerate(blocks) if b is not None]
    out = [(names[k], packed[k], gaps[k]) for k, b in enumerate(blocks) if b is None]
    if real:
        sizes = [len(packed[k]) // 4 for k in real]
        hashes = np.concatenate([np.frombuffer(packed[k], np.uint32) for k in real])
        aligned = np.concatenate([np.unpackbits(np.frombuffer(blocks[k], np.uint8), count=n).astype(bool) for k, n in zip(real, sizes, strict=True)])
        index = np.unique(hashes[aligned])
        if len(index):
            hit = index[np.minimum(np.searchsorted(index, hashes), len(index) - 1)] == hashes
            value, times = np.unique(hashes[hit], return_counts=True)
            twice = value[times > 1]
            if len(twice):
                hit &= twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes
                at = 0
                for k, n in zip(real, sizes, strict=True):
                    own = np.flatnonzero(hit[at : at + n])
                    at += n
                    if len(own):
                        out.append((names[k], None, _unpack_gaps(gaps[k])[own].astype(np.int64).tobytes()))
    return pa.table({"slice": pa.array([r[0] for r in out], pa.int64()), "keys": pa.array([r[1] for r in out], pa.binary()), "at": pa.array([r[2] for r in out], pa.binary())})


def _extend(block: int, window: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one slice: for each text with anchors the windows that hold one, as spans of starts (first, past the last)."""
        keys, at = table.column("keys").to_pylist(), table.column("at").to_pylist()
        own = [k for k, v in enumerate(keys) if v is not None]
        hits = [np.frombuffer(at[k], np.int64) for k, v in enumerate(keys) if v is None]
        out_key, out_spans = [], []
        if hits and own:
            hits = np.unique(np.concatenate(hits))
            key, cut = np.frombuffer(keys[own[0]], np.int64), np.frombuffer(at[own[0]], np.int64)
            doc = np.searchsorted(cut, hits, side="right") - 1
            for d in np.unique(doc):
                n = cut[d + 1] - cut[d]
                mine = hits[doc == d] - cut[d]
                lo, hi = np.maximum(mine - (window - block), 0), np.minimum(mine, n - window) + 1
                ok = lo < hi
                lo, hi = lo[ok], hi[ok]
                if not len(lo):
                    continue
                first = np.r_[True, lo[1:] > np.maximum.accumulate(hi)[:-1]]
                begins = np.flatnonzero(first)
                spans = np.stack([lo[begins], np.maximum.reduceat(hi, begins)], axis=1)
                out_key.append(int(key[d]))
                out_spans.append(spans.astype(np.int32).tobytes())
        return pa.table({"key": pa.array(out_key, pa.int64()), "spans": pa.array(out_spans, pa.binary())})

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, spans = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi, buf, offsets in slices(batch.column(1)):
                starts, _, words = words_of(buf, offsets, lower=False)
                cut = np.searchsorted(starts, offsets)
                hashes = window_hashes(words, window)
                checks = (window_hashes(mix(words + _SECOND), window) >> np.uint64(33)).astype(np.int32)
                took, took_check, took_key, took_at = [], [], [], []
                for k in range(lo, hi):
                    base = cut[k - lo]
                    for a, b in np.frombuffer(spans[k], np.int32).reshape(-1, 2).astype(np.int64):
                        took.append(hashes[base + a : base + b])
                        took_check.append(checks[base + a : base + b])
                        took_key.append(np.full(b - a, keys[k], np.int64))
                        took_at.append(np.arange(a, b, dtype=np.int32))
                if took:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(took).view(np.int64)), pa.array(np.concatenate(took_check)), pa.array(np.concatenate(took_key)), pa.array(np.concatenate(took_at))], names=["hash", "check", "key", "at"])

    return run


def repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (key, starts) of texts with repeated windows: key is text_key()'s; starts the words at which such windows begin, ascending.

    Equal rows of docs have one key and give one row."""
    block = (window + 1) // 2
    keyed = docs.select(text_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, int(total // RANGE_BYTES) + 1)
    packed = keyed.mapInArrow(_pack(block, ranges), PACKED)
    probed = packed.groupBy("bucket").applyInArrow(_probe, "slice long, keys binary, at binary")
    anchored = Saved(probed.groupBy("slice").applyInArrow(_extend(block, window), "key long, spans binary").dropDuplicates(["key"]), "anchors")
    near = keyed.join(small(anchored.df, BROADCAST_BYTES), "key")
    windows = Saved(near.select("key", "text", "spans").mapInArrow(_windows(window), "hash long, check int, key long, at int"), "windows").df
    name = ["hash", "check"]
    again = Saved(windows.groupBy(*name).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again").df
    # a window that stands in very many places is no task's own: it is looked up where its places lie
    hot = small(again.where(F.col("n") > HOT).select(*name), BROADCAST_BYTES)
    cold = windows.join(hot, name, "left_anti").join(again.where(F.col("n") <= HOT).select(*name), name, "left_semi")
    found = windows.join(hot, name, "left_semi").union(cold)
    return found.groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def text_key(id_col: str, text_col: str):
    """A 64-bit name of a row's id and text."""
    return F.xxhash64(F.col(id_col).cast("string"), F.lit("|"), F.col(text_col).cast("string"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 and, if texts, kept_text (the kept words joined by spaces)."""
    found = Saved(repeats(docs, window, id_col, text_col), "repeats")
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), text_key(id_col, text_col).alias("key"))
    # always shuffled: what is found grows with the input
    rows = keyed.join(found.df, "key", "left").select("id", "text", "starts")
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests, kept_texts = [], [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                if starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = starts.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    keep = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                    removed.append(len(words) - len(keep))
                    words = [words[k] for k in keep.tolist()]
                else:
                    removed.append(0)
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    kept_texts.append(kept.decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept_texts, pa.string())] if texts else []), names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + texts])

    return rows.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts).withColumnRenamed("id", id_col)


def op7_substring_dup(spark, sf_dir: str) -> DataFrame:
    """Every document without the passages of 35 words or more that also stand elsewhere."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
