"""Scoring texts with a Brown class-based n-gram model (operator 2).

Tokens are white-space words with A-Z lower-cased, then one end per text.  P(w | v) = P(class w | class of v as
history) * P(w | class w).  Every word met at least ``LEAST`` times, however large the corpus, gets its class by
exchange clustering; words met once belong, by their shape, to one of 16 further classes, and the end is a class
of its own.

Clustering runs in two parts.  The core, the words that make up at least ``CORE_SHARE`` of all tokens each (so at
most 200,000 words, whatever the corpus), is broadcast and clustered over its bigrams: in a round, half of the
words move to the class that raises the likelihood of the class bigrams most, all others staying; a round that
lowers the likelihood is undone and smaller shares move, and rounds go on until they gain next to nothing.  The rest stays a table
by word, with the word's places and how often each class precedes it: the same exchange runs over that table, in
rounds too, and nothing of it is collected but sums by class.  As history, a word of the core is seen as its class, any other
word as its shape; so what stands before a word is known where the text is read.

Transitions are smoothed by Witten-Bell interpolation with the classes' frequencies.  A class of shapes has one
slot for unseen words, whose share follows from how many words were met once and twice; its known words share
the remainder evenly.  The probabilities of all words, unseen ones as one word for each shape, sum to one.

All counts are exact and cover all training texts.  A word outside the core is scored in all its places where it
is gathered, and the texts' sums come together by text.  One row holds the places of one such word, of which there
are at most ``CORE_SHARE`` of all tokens and at most ``MOST_PLACES``.

Defined results: a null or empty text is its end alone; a null id is not held out; repeated rows count
and are returned each; with no training text every word is unseen (N = 0, V = 0); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from weir.llm.tables import Saved, fixed, free
from weir.llm.text_hash import LOWER, slices, words_of

LEAST = 2
CORE_SHARE = 5e-6
#: A word met more often than this belongs to the core too, so that the places of any other word fit one row.
MOST_PLACES = 10_000_000
CLASSES = 64
#: Words are taken as settled when a sweep over them raises the log likelihood by a smaller share than this; so many rounds at most.
SETTLED = 3e-3
MOST_ROUNDS = 40
MOST_PARTS = 32
SHAPES = 16
END = b"\n"
FLUSH = 1_000_000


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, and the end."""
    words = text.encode().lower().split() if text else []
    words.append(END)
    return words


def shape(word: bytes) -> int:
    """One of 16 classes of rare words: non-ASCII, digits, last byte no letter, long."""
    last = word[-1]
    return 8 * (not word.isascii()) + 4 * (len(word.translate(None, b"0123456789")) < len(word)) + 2 * (not (97 <= last < 123 or last >= 128)) + (len(word) > 8)


def name(word: bytes) -> tuple[int, int]:
    """How a word is known: a 64-bit hash, and 28 bits of its length, first and last byte, and shape.  The end is known as 0, 0."""
    buf = np.frombuffer(word, np.uint8)
    if word == END:
        return 0, 0
    starts, ends, hashes = words_of(buf, np.array([0, len(buf)]), lower=False)
    return int(hashes.view(np.int64)[0]), int(_marks(buf, starts, ends)[0])


# What bytes tell of a word's shape, and which end a word that is none of a sentence's.
_TELLS = np.zeros(256, np.uint8)
_TELLS[128:] = 8
_TELLS[48:58] = 4
_ODD = np.full(256, 2, np.uint8)
_ODD[97:123] = 0
_ODD[128:] = 0


def _marks(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 28 bits of many words; the last four are their shapes."""
    if not len(starts):
        return np.zeros(0, np.int64)
    sizes = ends - starts
    # a word's last byte never is the buffer's end plus one, so runs end at the next word's start or the end
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[0::2], bounds[1::2] = starts, ends
    tells = _TELLS[buf]
    tells = np.bitwise_or.reduceat(np.r_[tells, np.uint8(0)], bounds)[0::2]
    last = buf[ends - 1]
    shapes = tells | _ODD[last] | (sizes > 8)
    return np.minimum(sizes, 255) << 20 | buf[starts].astype(np.int64) << 12 | last.astype(np.int64) << 4 | shapes


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 7; never for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, mark, n) of words, known as name() has it."""
    held: list[pa.Table] = []
    ends = waiting = 0

    def out() -> pa.RecordBatch:
        sums = pa.concat_tables(held).group_by(["h", "mark"]).aggregate([("n", "sum")])
        held.clear()
        return sums.select(["h", "mark", "n_sum"]).rename_columns(["h", "mark", "n"])

    for batch in batches:
        for lo, hi, buf, offsets in slices(batch.column(0)):
            buf = LOWER[buf]
            starts, stops, hashes = words_of(buf, offsets, lower=False)
            held.append(pa.table({"h": hashes.view(np.int64), "mark": _marks(buf, starts, stops).astype(np.int32), "n": np.ones(len(hashes), np.int64)}))
            ends += hi - lo
            waiting += len(hashes)
            if waiting > FLUSH:
                yield from out().combine_chunks().to_batches()
                waiting = 0
    if ends:
        held.append(pa.table({"h": pa.array([0], pa.int64()), "mark": pa.array([0], pa.int32()), "n": pa.array([ends], pa.int64())}))
    if held:
        yield from out().combine_chunks().to_batches()


@dataclass
class Vocabulary:
    """Exact counts: n of each word of the core, the end first; of each shape the words met once and twice; of all, tokens and distinct words."""

    hashes: np.ndarray
    marks: np.ndarray
    counts: np.ndarray
    shape_once: np.ndarray
    shape_twice: np.ndarray
    total: int
    distinct: int

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self) -> dict[tuple[int, int], int]:
        return {(int(h), int(m)): i for i, (h, m) in enumerate(zip(self.hashes, self.marks, strict=True))}


def vocabulary(training: DataFrame, least: int = LEAST, core_share: float = CORE_SHARE) -> Vocabulary:
    """Word counts of training(text)."""
    counts = Saved(training.mapInArrow(_count_words, "h long, mark int, n long").groupBy("h", "mark").agg(F.sum("n").alias("n")), "words")
    sums = counts.df.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = int(sums[0] or 0)
    often = (F.col("n") >= min(MOST_PLACES, max(least, core_share * total))) | (F.col("mark") == 0)
    # at most 1 / core_share words, or total / MOST_PLACES
    top = counts.df.where(often).select("h", "mark", "n").toArrow()
    h, marks, n = (top[c].to_numpy() for c in ("h", "mark", "n"))
    if not len(n):
        h, marks, n = (np.zeros(1, np.int64) for _ in range(3))
    order = np.lexsort((marks, h, -n, marks != 0))
    few = counts.df.where((F.col("n") <= 2) & (F.col("mark") != 0)).groupBy(F.col("mark").bitwiseAND(F.lit(SHAPES - 1)).alias("s"), "n").agg(F.count(F.lit(1)).alias("v")).collect()
    once, twice = np.zeros((2, SHAPES), np.int64)
    for r in few:
        (once if r["n"] == 1 else twice)[r["s"]] = r["v"]
    counts.drop()
    return Vocabulary(h[order], marks[order].astype(np.int64), n[order].astype(np.int64), once, twice, total, int(sums[1]))


class _Reader:
    """Reads texts a slice at a time, all words at once, and finds those of the core in a table with open places."""

    def __init__(self, vocab: Vocabulary):
        self.size, self.marks = len(vocab), vocab.marks
        hashes, ids = vocab.hashes[1:].view(np.uint64), np.arange(1, len(vocab))
        bits = max(8, int(len(vocab) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ids, self.depth = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), 0
        while len(ids):
            place = ((hashes >> self.shift).astype(np.int64) + self.depth) & self.mask
            _, first = np.unique(place, return_index=True)
            first = first[self.keys[place[first]] == 0]
            self.keys[place[first]], self.ids[place[first]] = hashes[first], ids[first]
            left = np.ones(len(ids), bool)
            left[first] = False
            hashes, ids, self.depth = hashes[left], ids[left], self.depth + 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word with the hash of one of the core, 0 of others."""
        place = (hashes >> self.shift).astype(np.int64)
        out = np.where(self.keys[place] == hashes, self.ids[place], 0)
        open_ = np.flatnonzero((out == 0) & (self.keys[place] != 0))
        for d in range(1, self.depth):
            at = (place[open_] + d) & self.mask
            key = self.keys[at]
            hit = key == hashes[open_]
            out[open_[hit]] = self.ids[at[hit]]
            open_ = open_[~hit & (key != 0)]
        return out

    def read(self, texts: pa.Array) -> Iterator[tuple]:
        """Of each slice: its first and last row; of all its tokens, an end after each text, the numbers, rows and numbers of the tokens before; which lie outside
        the core; and those words' hashes and marks."""
        for lo, hi, buf, offsets in slices(texts):
            buf = LOWER[buf]
            starts, ends, hashes = words_of(buf, offsets, lower=False)
            sizes = np.diff(np.searchsorted(starts, offsets))
            text = np.repeat(np.arange(hi - lo), sizes)
            number, marks = self.find(hashes), _marks(buf, starts, ends)
            number[self.marks[number] != marks] = 0
            rest = np.flatnonzero(number == 0)
            number[rest] = self.size + (marks[rest] & SHAPES - 1)
            row = np.zeros(len(number) + hi - lo, np.int64)
            row[np.arange(len(number)) + text] = number  # what is left are the ends, which are word 0
            before = np.empty_like(row)
            before[:1], before[1:] = 0, row[:-1]  # a text begins after an end
            yield lo, hi, row, np.repeat(np.arange(hi - lo), sizes + 1), before, rest + text[rest], hashes[rest], marks[rest]


def _bigrams(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(sent.value)
        size = reader.size + SHAPES
        held, waiting = [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

        for batch in batches:
            for _, _, row, _, before, *_ in reader.read(batch.column(0)):
                held.append(before * size + row)
                waiting += len(row)
                if waiting > FLUSH:
                    yield out()
                    waiting = 0
        yield out()

    return run


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (w, o, n, bo, bn) of the rows (w, side, n) of each word, which come sorted by w: the words after it and how often, and those before it, as bytes.

    side is twice the other word, and one more where that comes before."""

    def out(w: np.ndarray, side: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        by = np.lexsort((side >> 1, side & 1, w))
        w, side, n = w[by], side[by], n[by]
        begins = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        word, other = np.cumsum(np.r_[0, w[1:] != w[:-1]]), (side >> 1).astype(np.int32)
        columns = [pa.array(w[begins])]
        for before in (0, 1):
            mine = side & 1 == before
            sizes = np.bincount(word[mine], minlength=len(begins))
            columns += [_binary(other[mine], sizes), _binary(n[mine], sizes)]
        return pa.RecordBatch.from_arrays(columns, names=["w", "o", "n", "bo", "bn"])

    return _by_first(batches, out)


def _by_first(batches: Iterator[pa.RecordBatch], out) -> Iterator[pa.RecordBatch]:
    """out() of the columns of batches that come sorted by the first one; a value of it that goes over into the next batch is carried on."""
    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(c.to_numpy() for c in batch.columns)
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut or (held and held[0][0][0] != now[0][0]):
            yield out(*(np.concatenate(x) for x in zip(*held, tuple(c[:cut] for c in now), strict=True)))
            held = []
        held.append(tuple(c[cut:] for c in now))
    if held:
        yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of the values, of the given sizes, as bytes."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of an array of bytes, one after another, and where each row's begin."""
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(values.tobytes(), kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for terms that no class change alters."""
    return float(_plogp(table).sum() - _plogp(table.sum(axis=1)).sum() - _plogp(table.sum(axis=0)).sum())


def best_class(own: int, after: np.ndarray, before: np.ndarray, self_n: float, table: np.ndarray, free: int) -> int:
    """The class, of the first ``free``, to which a word should move.

    after, before: how often each class follows and precedes the word, but for the word itself; self_n: how often it follows itself."""
    t = table.copy()
    t[own] -= after
    t[:, own] -= before
    t[own, own] -= self_n
    rows, columns = t.sum(axis=1), t.sum(axis=0)
    a, b = np.flatnonzero(after), np.flatnonzero(before)
    gain = (_plogp(t[:free, a] + after[a]) - _plogp(t[:free, a])).sum(axis=1) + (_plogp(t[b, :free].T + before[b]) - _plogp(t[b, :free].T)).sum(axis=1)
    d = np.arange(free)
    cell = t[d, d]
    gain += _plogp(cell + after[d] + before[d] + self_n) - _plogp(cell + after[d]) - _plogp(cell + before[d]) + _plogp(cell)
    out, into = after.sum() + self_n, before.sum() + self_n
    gain -= _plogp(rows[:free] + out) - _plogp(rows[:free]) + _plogp(columns[:free] + into) - _plogp(columns[:free])
    top = int(gain.argmax())
    return top if gain[top] > gain[own] + 1e-9 else own


def _class_table(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, k = sent.value
        table = np.zeros(k * k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            (others, begins), (n, _) = _values(batch.column(1), np.int32), _values(batch.column(2), np.int64)
            own = np.repeat(classes[batch.column(0).to_numpy()], np.diff(begins))
            table += np.bincount(own * k + classes[others], n, k * k).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["cells"])

    return run


def _moves(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, table, free, turn, parts, n_words = sent.value
        k = len(table)
        words, moved = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [(*_values(batch.column(at), np.int32), _values(batch.column(at + 1), np.int64)[0]) for at in (1, 3)]
            for i, w in enumerate(batch.column(0).to_pylist()):
                if w == 0 or w >= n_words or (w * 40503 >> 6) % parts != turn:
                    continue
                sides, itself = [], 0.0
                for others, begins, times in lists:
                    other, n = others[begins[i] : begins[i + 1]], times[begins[i] : begins[i + 1]].astype(float)
                    own = other == w
                    itself = float(n[own].sum())
                    n[own] = 0
                    sides.append(np.bincount(classes[other], n, k))
                to = best_class(int(classes[w]), *sides, itself, table, free)
                if to != classes[w]:
                    words.append(w)
                    moved.append(to)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(moved, pa.int64())], names=["word", "class"])

    return run


def _placed(sent):
    """A row (h, key, mark) for each token outside the core: its hash, its text, and above the class before it (16 bits) whether the text is held out, and its mark (28 bits from 32 on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, classes = sent.value
        reader = _Reader(vocab)
        for batch in batches:
            keys, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, _, _, text, before, rest, hashes, marks in reader.read(batch.column(2)):
                at = text[rest] + lo
                mark = classes[before[rest]] | held[at] << 16 | marks << 32
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(keys[at]), pa.array(mark)], names=["h", "key", "mark"])

    return run


PLACED = "h long, mark int, n long, g binary, m binary, keys binary, before binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of the rows (h, key, mark) of each word, which come sorted by h; a word that goes over into the next batch is carried on.

    n: how often training texts have it; g and m, as bytes: the classes that stand before it there, and how often; keys and before: all its
    places, by text and class before."""

    def out(h: np.ndarray, key: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
        own = mark >> 32
        if ((h[1:] == h[:-1]) & (own[1:] != own[:-1])).any():  # different words with one hash
            by = np.lexsort((own, h))
            h, key, mark, own = h[by], key[by], mark[by], own[by]
        new = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]
        begins, word = np.flatnonzero(new), np.cumsum(new) - 1
        g, learnt = mark & 0xFFFF, mark >> 16 & 1 == 0
        cells, m = np.unique(word[learnt] << 16 | g[learnt], return_counts=True)
        sizes = np.diff(np.searchsorted(cells, np.arange(len(begins) + 1) << 16))
        places = np.diff(np.r_[begins, len(h)])
        columns = [pa.array(h[begins]), pa.array(own[begins].astype(np.int32)), pa.array(np.bincount(word[learnt], minlength=len(begins)))]
        columns += [_binary((cells & 0xFFFF).astype(np.uint16), sizes), _binary(m.astype(np.int64), sizes), _binary(key, places), _binary(g.astype(np.uint16), places)]
        return pa.RecordBatch.from_arrays(columns, names=["h", "mark", "n", "g", "m", "keys", "before"])

    return _by_first(batches, out)


class _Exchange:
    """Moves words outside the core, round after round, each to the class, of the free ones, that raises the likelihood most.

    A round is the class bigrams before it, whose turn it is, of how many; all words move in the first.  What a word does follows from its own
    counts alone, so the rounds so far are played again wherever its class is wanted, and no class has to be kept by word."""

    def __init__(self, free: int, rounds: list[tuple[np.ndarray, int, int]]):
        self.free, self.rounds, self.costs = free, rounds, []
        for table, _, _ in rounds:
            into = _plogp(table[:, 1 : 1 + free])
            # what one to eight more cost in each cell; greater counts are worked out
            self.costs.append((into, np.stack([_plogp(table[:, 1 : 1 + free] + k) - into for k in range(9)])))

    def classes(self, n: np.ndarray, shapes: np.ndarray, turns: np.ndarray, g: np.ndarray, m: np.ndarray, begins: np.ndarray) -> np.ndarray:
        own = shapes + 1 + self.free
        for lo in range(0, len(own), 4096):
            hi = min(lo + 4096, len(own))
            span = slice(begins[lo], begins[hi])
            for (table, turn, parts), (into, more) in zip(self.rounds, self.costs, strict=True):
                own[lo:hi] = self._round(table, into, more, own[lo:hi], n[lo:hi].astype(float), g[span], m[span], begins[lo : hi + 1] - begins[lo], turns[lo:hi] % parts == turn)
        return own

    def _round(self, table, into, more, c, n, g, m, begins, may):
        free, at, sizes = self.free, begins[:-1], np.diff(begins)
        cost = more[np.minimum(m, 8), g]
        large = np.flatnonzero(m > 8)
        cost[large] = _plogp(table[g[large], 1 : 1 + free] + m[large, None]) - into[g[large]]
        column = table.sum(axis=0)
        total = column[1 : 1 + free]
        gain = np.add.reduceat(cost, at, axis=0) - _plogp(total + n[:, None]) + _plogp(total)
        here = table[g, np.repeat(c, sizes)]
        stay = np.add.reduceat(_plogp(here) - _plogp(here - m), at) - _plogp(column[c]) + _plogp(column[c] - n)
        # a word's own class counts without the word
        inside = np.flatnonzero((c >= 1) & (c <= free))
        gain[inside, c[inside] - 1] = stay[inside]
        best = gain.argmax(axis=1) + 1
        moves = may & (gain[np.arange(len(c)), best - 1] > stay + 1e-9) | (c > free)
        return np.where(moves, best, c)


def _replayed(batch: pa.RecordBatch, at: dict[str, int], exchange: _Exchange, least: int) -> tuple[np.ndarray, ...]:
    """Of a batch of gathered words the classes, after the rounds, of those met often enough, -1 of the others, with their counts and classes before."""
    n, shapes, turns = batch.column(at["n"]).to_numpy(), batch.column(at["mark"]).to_numpy() & SHAPES - 1, batch.column(at["h"]).to_numpy() & 0xFF
    (g, begins), (m, _) = _values(batch.column(at["g"]), np.uint16), _values(batch.column(at["m"]), np.int64)
    often = np.flatnonzero(n >= least)
    sizes = np.diff(begins)[often]
    new = np.r_[0, np.cumsum(sizes)]
    pick = np.repeat(begins[often] - new[:-1], sizes) + np.arange(new[-1])
    g, m = g[pick].astype(np.int64), m[pick]
    own = np.full(len(n), -1, np.int64)
    own[often] = exchange.classes(n[often], shapes[often].astype(np.int64), turns[often], g, m, new)
    return own, g, m, np.repeat(own[often], sizes)


def _rest_cells(sent, k: int):
    """How often each class follows each class as history, over the words that move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free, rounds, least = sent.value
        exchange = _Exchange(free, rounds)
        table = np.zeros(k * k, np.int64)
        for batch in batches:
            if batch.num_rows:
                _, g, m, c = _replayed(batch, {c: i for i, c in enumerate(("h", "mark", "n", "g", "m"))}, exchange, least)
                table += np.bincount(g * k + c, m, k * k).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["cells"])

    return run


@dataclass
class Model:
    vocab: Vocabulary
    classes: np.ndarray  # of each word of the core and of each shape
    table: np.ndarray  # how often each class follows each class as history
    log_next: np.ndarray  # log10 P(class | class before)
    log_word: np.ndarray  # log10 P(word | class) of each word of the core
    log_class: np.ndarray  # log10 of each class's tokens
    log_once: np.ndarray  # of each shape, log10 P(word | class) of a word met once
    log_unseen: np.ndarray  # of each shape, the same of all unseen words together
    free: int
    least: int
    rounds: list  # of the exchange outside the core
    places: Saved | None = None  # the words outside the core, gathered
    keyed: DataFrame | None = None  # the texts with the keys under which they were gathered

    def sent(self) -> Model:
        """What tasks need of it."""
        return replace(self, places=None, keyed=None)

    @property
    def rest(self) -> DataFrame:
        """The training words outside the core: h and mark, which name() has, n, class (null of a word met once)."""
        names = ("h", "mark", "n", "g", "m")
        sent = self.places.spark.sparkContext.broadcast(self.sent())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            exchange = _Exchange(model.free, model.rounds)
            for batch in batches:
                if batch.num_rows:
                    own = _replayed(batch, {c: i for i, c in enumerate(names)}, exchange, model.least)[0]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own.astype(np.int32), mask=own < 0)], names=["h", "mark", "n", "class"])

        return self.places.df.where("n > 0").select(*names).mapInArrow(run, "h long, mark int, n long, class int")


def _summed(tables: DataFrame, k: int) -> np.ndarray:
    """The sum of the tasks' tables, brought together in a few tasks first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(k * k, np.int64)
        for batch in batches:
            for cells in batch.column(0).to_pylist():
                table += np.frombuffer(cells, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["cells"])

    rows = tables.repartition(4).mapInArrow(add, "cells binary").collect()
    return sum((np.frombuffer(r["cells"], np.int64) for r in rows), np.zeros(k * k, np.int64)).reshape(k, k)


class _Settling:
    """Decides on rounds that each move one of ``parts`` shares of the words: a round that lowers the likelihood is undone and followed by
    rounds of half the share; they end once a whole sweep has gained next to nothing, or such small shares still do harm."""

    def __init__(self, share: float, parts: int = 2):
        self.share, self.parts = share, parts
        self.gains: list[float] = []

    def better(self, old: np.ndarray, new: np.ndarray) -> bool:
        before, after = likelihood(old), likelihood(new)
        if after <= before:
            # where nothing moves, nothing is left to do for this share of the words
            self.parts, self.gains = (self.parts, [*self.gains, 0.0]) if after == before else (2 * self.parts, [])
            return False
        self.gains.append((after - before) / abs(before))
        return True

    @property
    def done(self) -> bool:
        return self.parts > MOST_PARTS or (len(self.gains) >= self.parts and sum(self.gains[-self.parts :]) < self.share)


def _core_classes(spark, training: DataFrame, vocab: Vocabulary, classes: int, most_rounds: int, settled: float) -> tuple[np.ndarray, np.ndarray]:
    """The class of each word of the core and each shape, and the class bigrams with every other word in its shape's class."""
    size = len(vocab) + SHAPES
    sent = spark.sparkContext.broadcast(vocab)
    grams = training.mapInArrow(_bigrams(sent), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pair = grams.select((F.col("key") / size).cast("long").alias("a"), (F.col("key") % size).alias("b"), "n")
    side = lambda w, o, before: F.struct(F.col(w).alias("w"), (F.col(o) * 2 + before).alias("side"), "n")
    sides = pair.select(F.explode(F.array(side("a", "b", 0), side("b", "a", 1))).alias("s")).select("s.*")
    # a row per word with its neighbours: at most two entries for each word of the core or shape
    lists = sides.repartition("w").sortWithinPartitions("w").mapInArrow(_laid, "w long, o binary, n binary, bo binary, bn binary")
    # dealt evenly once; the rounds read the files
    n_files = max(2 * spark.sparkContext.defaultParallelism, vocab.total // 500_000)
    laid_table = Saved(lists.repartition(n_files), "bigrams")
    laid = laid_table.df
    del grams, pair, sides, lists
    free(spark)
    # classes: 0 the end; then the free ones; then the shapes
    k = 1 + classes + SHAPES
    now = np.r_[0, 1 + np.arange(len(vocab) - 1) % classes, np.arange(SHAPES) + 1 + classes].astype(np.int64)

    def table_of(c: np.ndarray) -> np.ndarray:
        b = spark.sparkContext.broadcast((c, k))
        out = _summed(laid.select("w", "o", "n").mapInArrow(_class_table(b), "cells binary"), k)
        b.unpersist()
        return out

    table = table_of(now)
    # word 0 and the shapes stay; the end's class is no target: classes are shifted by one within a round
    shift = np.r_[np.arange(1, k), 0]
    back = np.argsort(shift)
    settling = _Settling(settled)
    for turn in range(most_rounds):
        b = spark.sparkContext.broadcast((back[now], table[np.ix_(shift, shift)].astype(float), classes, turn % settling.parts, settling.parts, len(vocab)))
        tried = now.copy()
        moves = laid.mapInArrow(_moves(b), "word long, class long").toArrow()  # at most one row a word of the core
        tried[moves["word"].to_numpy()] = shift[moves["class"].to_numpy()]
        b.unpersist()
        new = table_of(tried)
        if settling.better(table, new):
            now, table = tried, new
        if settling.done:
            break
    laid_table.drop()
    return now, table


def _keyed(docs: DataFrame, is_held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """Rows (key, id, held_out, text): the key is that of the row's place in its partition, so it is one text's own whatever the ids.

    Texts are read more than once, so what isn't a plain scan is copied first."""
    return fixed(docs, "texts").select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), is_held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))


def train(docs: DataFrame, is_held_out: Column | None = None, classes: int = CLASSES, rounds: int = MOST_ROUNDS, least: int = LEAST, core_share: float = CORE_SHARE, settled: float = SETTLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the texts of docs that are not held out; it also keeps where all texts have words outside the core."""
    spark = docs.sparkSession
    keyed = _keyed(docs, F.lit(False) if is_held_out is None else is_held_out, id_col, text_col)
    training = keyed.where(~F.col("held_out")).select("text")
    vocab = vocabulary(training, least, core_share)
    k = 1 + classes + SHAPES
    now, table = _core_classes(spark, training, vocab, classes, rounds, settled)
    sent = spark.sparkContext.broadcast((vocab, now))
    rows = keyed.select("key", "held_out", "text").mapInArrow(_placed(sent), "h long, key long, mark long")
    places = Saved(rows.repartition("h").sortWithinPartitions("h").mapInArrow(_gathered, PLACED), "places")
    free(spark)

    def cells(played: list) -> np.ndarray:
        b = spark.sparkContext.broadcast((classes, played, least))
        return _summed(places.df.where(F.col("n") >= least).select("h", "mark", "n", "g", "m").mapInArrow(_rest_cells(b, k), "cells binary"), k)

    # until the first round, the words are in their shapes' classes, as the core has seen them
    others, played, settling = table - cells([]), [], _Settling(settled, 1)
    for turn in range(rounds):
        tried = [*played, (table.astype(float), turn % settling.parts, settling.parts)]
        new = others + cells(tried)
        # the first round takes all words out of their shapes' classes; a last one that gains next to nothing need not be played
        if (settling.better(table, new) and not settling.done) or not played:
            played, table = tried, new
        if settling.done:
            break
    tokens_of = table.sum(axis=0).astype(float)
    base = (tokens_of + (np.arange(k) > classes)) / (tokens_of.sum() + SHAPES)  # each shape has a slot for unseen words
    after, kinds = table.sum(axis=1, keepdims=True).astype(float), (table > 0).sum(axis=1, keepdims=True) + 1.0
    following = (table + kinds * base) / (after + kinds)
    # of a shape's words, those never met have as much as those met once and twice suggest; the words met once share the remainder
    unseen = (vocab.shape_once + 1) / (vocab.shape_once + 2 * vocab.shape_twice + 2)
    each = (1 - unseen) / np.maximum(vocab.shape_once, 1)
    with np.errstate(divide="ignore"):
        log_word = np.log10(vocab.counts / tokens_of[now[: len(vocab)]]) if vocab.total else np.zeros(1)
        return Model(vocab, now, table, np.log10(following), log_word, np.log10(np.maximum(tokens_of, 1)), np.log10(each), np.log10(unseen), classes, least, played, places, keyed)


SUMS = "key long, id {}, held_out boolean, n_tokens long, n_known long, base double, score double"


def _core_scores(sent, kind: pa.DataType):
    """A row for each text: what its words of the core give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        vocab = model.vocab
        reader = _Reader(vocab)
        log_base = np.log10((vocab.counts + 1) / (vocab.total + vocab.distinct + 1))
        for batch in batches:
            for lo, hi, row, text, before, *_ in reader.read(batch.column(3)):
                known = np.flatnonzero(row < reader.size)
                c, g, at = model.classes[row[known]], model.classes[before[known]], text[known]
                n_known = np.bincount(at, minlength=hi - lo) if vocab.total else np.zeros(hi - lo, np.int64)
                base, score = (np.bincount(at, w, hi - lo) for w in (log_base[row[known]], model.log_next[g, c] + model.log_word[row[known]]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(np.bincount(text, minlength=hi - lo)), pa.array(n_known), pa.array(base), pa.array(score)], names=["key", "id", "held_out", "n_tokens", "n_known", "base", "score"])

    return run


def _rest_scores(sent, kind: pa.DataType):
    """Rows for texts, a batch of words at a time: what their words outside the core give."""
    names = ("h", "mark", "n", "g", "m", "keys", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        vocab = model.vocab
        exchange = _Exchange(model.free, model.rounds)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _replayed(batch, {c: i for i, c in enumerate(names)}, exchange, model.least)[0]
            n, shapes = batch.column(2).to_numpy(), batch.column(1).to_numpy().astype(np.int64) & SHAPES - 1
            log_word = np.where(own >= 0, np.log10(np.maximum(n, 1)) - model.log_class[own], np.where(n > 0, model.log_once[shapes], model.log_unseen[shapes]))
            own = np.where(own >= 0, own, shapes + 1 + model.free)
            (keys, begins), (g, _) = _values(batch.column(5), np.int64), _values(batch.column(6), np.uint16)
            word = np.repeat(np.arange(len(n)), np.diff(begins))
            log_base = np.log10((n + 1) / (vocab.total + vocab.distinct + 1))
            texts, at = np.unique(keys, return_inverse=True)
            sums = [np.bincount(at, w, len(texts)) for w in ((n > 0)[word], log_base[word], model.log_next[g, own[word]] + log_word[word])]
            nothing = pa.nulls(len(texts), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(texts), pa.nulls(len(texts), kind), nothing, pa.nulls(len(texts), pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["key", "id", "held_out", "n_tokens", "n_known", "base", "score"])

    return run


def score(model: Model, id_col: str = "doc_id") -> DataFrame:
    """One row per row of the model's texts, held out and trained on: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Words outside the core are scored where they are gathered."""
    keyed = model.keyed
    spark, kind = keyed.sparkSession, dict(keyed.dtypes)["id"]
    arrow = to_arrow_schema(keyed.select("id").schema).field(0).type
    sent = spark.sparkContext.broadcast(model.sent())
    own = keyed.mapInArrow(_core_scores(sent, arrow), SUMS.format(kind))
    rest = model.places.df.select("h", "mark", "n", "g", "m", "keys", "before").mapInArrow(_rest_scores(sent, arrow), SUMS.format(kind))
    # max needs a plain type to be summed in place, which ids have but for texts
    sums = own.union(rest).groupBy("key").agg(F.max("id").alias("id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return sums.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.vocab.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op2_brown_lm(spark, sf_dir: str) -> DataFrame:
    """All texts of documents, scored by a model of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"))
    return score(train(docs, out))
