"""Vectorised word splitting and hashing over Arrow string batches.

Words are the maximal runs of bytes that are not 0x20 or 0x09-0x0D.  A word's 64-bit hash depends on
its bytes alone, so tasks and executors agree on it.  Texts are taken in slices of about a megabyte;
a longer text is cut at white space into pieces of that size, so memory stays bounded by the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = int(_RNG.integers(1 << 62, 1 << 63)) | 5
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int, base: int = _STEP) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i below n, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE + 1)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, _U(b), np.uint64)
            p[0] = 1
            pair.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[base] = (pair[0], pair[1])
    return have[0][:n], have[1][:n]


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; one entry for each start at which n words are left."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out, step = [], SLICE
    for at in range(0, len(words) - n + 1, step):
        part = words[at : at + step + n - 1]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out.append(mix((sums[n:] - sums[:-n]) * down[: len(part) - n + 1] + _U(n)))
    return np.concatenate(out) if len(out) > 1 else out[0]


def _short(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = ~_SPACE[buf]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(buf: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of the texts that lie one after another in buf, bounded by offsets."""
    if lower:
        buf = LOWER[buf]
    if len(buf) <= SLICE or len(offsets) > 2:
        return _short(buf, offsets)
    parts, at, space = [], 0, np.flatnonzero(_SPACE[buf])
    while at < len(buf):
        k = np.searchsorted(space, at + SLICE)
        end = int(space[k]) if k < len(space) else len(buf)
        end = len(buf) if len(buf) - at <= SLICE else end
        s, e, h = _short(buf[at:end], np.array([0, end - at]))
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of runs of texts of about SLICE bytes (a null text has no bytes)."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
