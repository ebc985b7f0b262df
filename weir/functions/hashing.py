"""Content digests and the FNV hashes of seed assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases and primes of the hashes.
SCORE_BASIS, SLOT_BASIS, PRIME64 = 1469598103934665603, 14695981039346656037, 1099511628211
BASIS32, PRIME32 = 2166136261, 16777619


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def decoded_base64(text: Column) -> Column:
    """Binary, or null where it is no base64."""
    return F.try_to_binary(text, F.lit("base64"))


def fnv64(text: str, basis: int) -> int:
    """FNV-1a over UTF-16 code units, unsigned."""
    h = basis
    for unit in np.frombuffer(text.encode("utf-16-le"), np.uint16).tolist():
        h = ((h ^ unit) * PRIME64) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv32(text: str) -> float:
    """FNV-1a of 32 bits over UTF-16 code units, from 0 to 1."""
    h = BASIS32
    for unit in np.frombuffer(text.encode("utf-16-le"), np.uint16).tolist():
        h = ((h ^ unit) * PRIME32) & 0xFFFFFFFF
    return h / 4294967296


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 code units of many texts as a padded table, and how many each has."""
    raw = [np.frombuffer(t.encode("utf-16-le"), np.uint16) for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    table = np.zeros((len(raw), int(sizes.max()) if len(raw) else 0), np.uint64)
    for k, r in enumerate(raw):
        table[k, : len(r)] = r
    return table, sizes


def fnv_many(texts: list[str], basis: int, prime: int = PRIME64) -> np.ndarray:
    """FNV-1a of many texts at once, modulo 2**64."""
    table, sizes = _units(texts)
    h = np.full(len(texts), np.uint64(basis), np.uint64)
    for k in range(table.shape[1]):
        # texts that have ended keep their hash
        h = np.where(k < sizes, (h ^ table[:, k]) * np.uint64(prime), h)
    return h


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64).astype(np.float64)


def rendezvous_score(seed: Column, worker: Column) -> Column:
    """Score of a worker for a seed, as a double of the signed hash of ``seed|worker``."""

    @F.pandas_udf("double")
    def score(seeds: pd.Series, workers: pd.Series) -> pd.Series:
        return pd.Series(_signed(fnv_many([f"{s}|{w}" for s, w in zip(seeds, workers, strict=True)], SCORE_BASIS)))

    return score(seed, worker)


def best_worker(seed: Column, workers: list[int]) -> Column:
    """Of the workers the one with the best rendezvous score for the seed, on a tie the smallest; null for a null seed.

    Each seed is hashed once; a worker's digits then run on from there, for all seeds of a batch together, and nothing but the best is kept."""
    tails = [(w, [np.uint64(ord(c)) for c in str(w)]) for w in sorted(workers)]

    @F.pandas_udf("long")
    def best(seeds: pd.Series) -> pd.Series:
        start = fnv_many([f"{s}|" for s in seeds], SCORE_BASIS)
        top, chosen = np.full(len(seeds), -np.inf), np.zeros(len(seeds), np.int64)
        for w, tail in tails:
            h = start
            for unit in tail:
                h = (h ^ unit) * np.uint64(PRIME64)
            value = _signed(h)
            chosen = np.where(value > top, w, chosen)
            top = np.maximum(value, top)
        return pd.Series(chosen, dtype="Int64").where(seeds.notna())

    return best(seed)


def stable_slot(seed: Column, n: Column) -> Column:
    """Slot of a seed among n."""

    @F.pandas_udf("long")
    def slot(seeds: pd.Series, sizes: pd.Series) -> pd.Series:
        n = sizes.to_numpy(np.uint64)
        return pd.Series(np.where(n > 0, fnv_many(list(seeds), SLOT_BASIS) % np.maximum(n, np.uint64(1)), np.uint64(0)).astype(np.int64))

    return slot(seed, n)


def unit_hash(text: Column) -> Column:
    """FNV-1a of 32 bits, from 0 to 1; a null counts as empty.  The low half of a product modulo 2**64 is the product modulo 2**32."""

    @F.pandas_udf("double")
    def unit(values: pd.Series) -> pd.Series:
        h = fnv_many(list(values.fillna("")), BASIS32, PRIME32)
        return pd.Series((h & np.uint64(0xFFFFFFFF)).astype(np.float64) / 4294967296)

    return unit(text)


def hue(topic: Column) -> Column:
    return F.floor(unit_hash(F.coalesce(topic, F.lit("generic"))) * 360 + 0.5).cast("int")


__all__ = ["best_worker", "content_hash", "decoded_base64", "fnv32", "fnv64", "fnv_many", "hue", "rendezvous_score", "stable_slot", "unit_hash"]
