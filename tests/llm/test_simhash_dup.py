"""SimHash components against plain Python, the bit-sliced comparison against popcounts, and large buckets in blocks."""

import re

import numpy as np
import pytest
import xxhash

from weir.llm import simhash_dup as sd

SCHEMA = "doc_id long, text string, fp long, key string, id string, component_id int"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute(rows):
    """{(id, fingerprint): component} of rows (id, text)."""
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    parent = {i: i for i, _ in fps if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = sorted({(f, i) for i, f in fps if i is not None})
    values = np.array([f for f, _ in own], np.uint64)
    for k, (_, i) in enumerate(own):
        for m in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 4):
            x, y = sorted((root(i), root(own[m][1])))
            parent[y] = x
    return sorted(((i, f"{f:016x}", None if i is None else root(i)) for i, f in fps), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", "i", 0) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("block", [4096, 8])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(sd.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("block", "landmarks"), [(4096, 32), (16, 2), (16, 0)])
def test_crowds_of_near_copies(spark, monkeypatch, block, landmarks):
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "LANDMARKS", landmarks)
    monkeypatch.setattr(sd, "AT_ONCE", 64)
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in rng.integers(0, 900, 120)]
    rows = []
    for k in range(260):
        words = list(base) if k < 200 else [f"w{x}" for x in rng.integers(0, 900, 120)]
        for at in rng.integers(0, len(words), 1 + k % 5):
            words[at] = f"z{rng.integers(0, 40)}"
        rows.append((k, " ".join(words)))
    want = brute(rows)
    assert len({c for _, _, c in want}) > 60
    assert got(sd.near_duplicates(table(spark, rows))) == want


def test_nulls_empty_long_and_repeated_rows(spark):
    long = " ".join(f"w{k % 5000}" for k in range(400_000))
    rows = [(4, None), (3, ""), (9, " \t\n"), (5, "A b"), (6, "a  B"), (7, "a b c d e"), (7, "a b c d e"), (8, "other words stand in here"), (8, "a b"), (None, "a b"), (None, None), (10, long), (11, long.upper()), (12, "é À"), (13, "é à")]
    assert got(sd.near_duplicates(table(spark, rows))) == brute(rows)
    assert sd.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_bit_slices_equal_popcounts():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 640, dtype=np.uint64)
    for k in range(320):
        flips = rng.integers(0, 64, rng.integers(0, 9))
        fps[320 + k] = fps[k] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if len(flips) else fps[k]
    words, queries = np.tile(np.arange(10), 640), np.repeat(np.arange(640), 10)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :])
    for radius in (0, 3, 4, 15):
        at, hit = sd.within(fps[queries], words, sd.planes_of(fps), radius)
        found = np.zeros((640, 640), bool)
        bits = np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        found.reshape(640, 10, 64)[queries[at], words[at]] = bits
        assert (found == (near <= radius)).all()
        if radius == 4:
            assert len(at) < 0.25 * len(queries)  # the others were abandoned


@pytest.mark.parametrize("n", [10, 3_000_000, 10**10])
def test_linked_fingerprints_share_a_key(n):
    rng = np.random.default_rng(6)
    masks = sd.index_masks(n)
    assert len(masks) in (5, 15, 35)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & m == 0 for m in masks)
