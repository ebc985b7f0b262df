"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 1).

The model's pieces never hold a space mark after another character, so a text splits before each
space that follows a non-space and every segment is encoded on its own.  All new segments of a
slice of documents are laid out as one flat array of symbol ids; a round finds the smallest pair
rank of each segment, merges its leftmost non-overlapping occurrences at once, and compacts the
array, until no pair is left.  Merging all occurrences at once equals the library's one-by-one
order unless the merged symbol could take part in a pair of better rank; such ranks are found from
the vocabulary beforehand, and only their leftmost occurrence is merged in a round.

A long segment, as of a text without spaces, is cut further between characters that no piece holds side by
side: no merge can span such a place.

No shuffle: each task works through its own rows in slices of bounded size.

Defined results: a null or empty text has no ids and decodes to the empty text; a text of spaces
is encoded like any other; unknown characters become the ids of their UTF-8 bytes; rows with equal
or null ids stay separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNICODE = 0x110000
NO_RANK = np.iinfo(np.int32).max
SEGMENT = re.compile(" +[^ ]*")
LONG = 400
OUTPUTS = {
    "n_tokens": ("long", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


class MergeModel:
    """Pair ranks, character ids and byte ids of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece holds a space mark after another character; texts can't be split at spaces")
        self.size = n
        self.unknown = sp.unk_id()
        self.byte_ids = np.zeros(256, np.int32)
        self.byte_of = {}
        for i in range(n):
            if sp.is_byte(i):
                value = int(self.pieces[i][1:-1], 16)
                self.byte_ids[value] = i
                self.byte_of[i] = value
        self.text_of = ["" if special[i] else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.number = list(map(str, range(n)))
        self.plain = {i for i in range(n) if not special[i]}
        # a character that is no piece is the symbol n + code point
        self.char_ids = np.arange(n, n + UNICODE, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        self.width = n + UNICODE
        order = sorted((i for p, i in normal.items() if len(p) > 1), key=lambda i: (-sp.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        self.merged = np.array(order + [0], np.int32)
        symbol = lambda s: normal.get(s) if len(s) > 1 else int(self.char_ids[ord(s)])
        keys, ranks, early = [], [], set()
        for i in order:
            p = self.pieces[i]
            for k in range(1, len(p)):
                left, right = symbol(p[:k]), symbol(p[k:])
                if left is None or right is None:
                    continue
                keys.append(left * self.width + right)
                ranks.append(rank[i])
                early.update(rank[x] for x in (left, right) if x in rank and rank[x] > rank[i])
        by = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.array(keys, np.int64)[by]
        self.pair_ranks = np.array(ranks, np.int32)[by]
        self.one_by_one = np.zeros(len(order) + 1, bool)
        self.one_by_one[list(early)] = True

        joins = {ord(a) << 21 | ord(b) for p in normal for a, b in zip(p, p[1:], strict=False)}
        self.joins = np.array(sorted(joins) + [1 << 42], np.int64)

    def parts(self, segment: str) -> list[str]:
        """A long segment in runs of LONG characters or more that no merge spans, as far as it has such places."""
        if len(segment) <= LONG:
            return [segment]
        points = np.frombuffer(segment.replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        key = points[:-1] << 21 | points[1:]
        cuts = (np.flatnonzero(self.joins[np.searchsorted(self.joins, key)] != key) + 1).tolist()
        out, at = [], 0
        for cut in cuts:
            if cut - at >= LONG:
                out.append(segment[at:cut])
                at = cut
        return [*out, segment[at:]]

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK).astype(np.int32)

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment (spaces as they are in the text)."""
        if not segments:
            return []
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        points = np.frombuffer("".join(segments).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        symbols = self.char_ids[points]
        owner = np.repeat(np.arange(len(segments), dtype=np.int32), lengths)
        ranks = np.full(len(symbols), NO_RANK, np.int32)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inside] = self.pair_rank(symbols[inside], symbols[inside + 1])
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(ranks, starts)
            best = np.repeat(least, sizes)
            ready = best == NO_RANK
            if ready.any():
                done_symbols.append(symbols[ready])
                done_owner.append(owner[ready])
                going = ~ready
                symbols, owner, ranks, best = symbols[going], owner[going], ranks[going], best[going]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == best)
            first = np.r_[True, at[1:] != at[:-1] + 1]
            run = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            take = ((at - run) & 1) == 0
            single = self.one_by_one[ranks[at]]
            if single.any():
                take &= ~single | np.r_[True, owner[at[1:]] != owner[at[:-1]]]
            at = at[take]
            symbols[at] = self.merged[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            before = at[at > 0] - 1
            changed[before[keep[before]]] = True
            gone = before[~keep[before]]  # the left neighbour was itself merged away: its left half changed too
            changed[gone - 1] = True
            symbols, owner, ranks, changed = symbols[keep], owner[keep], ranks[keep], changed[keep]
            at = np.flatnonzero(changed)
            ranks[at] = NO_RANK
            at = at[at + 1 < len(symbols)]
            at = at[owner[at] == owner[at + 1]]
            ranks[at] = self.pair_rank(symbols[at], symbols[at + 1])
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        by = np.argsort(owner, kind="stable")
        symbols, counts = symbols[by], np.bincount(owner, minlength=len(segments))
        ends = np.cumsum(counts)
        flat = symbols.tolist()
        out = [flat[e - c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(symbols >= self.size), side="right")).tolist():
            out[k] = [i for s in out[k] for i in ([s] if s < self.size else self.byte_ids[list(chr(s - self.size).encode())].tolist())]
        return out

    def decode_ids(self, ids: Iterable[int], start: bool = True) -> str:
        """Text of the ids; start: whether the space put before every text is taken off again."""
        parts, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held = bytearray()
            parts.append(self.text_of[i] if i != self.unknown else " ⁇ ")
        if held:
            parts.append(held.decode("utf-8", "replace"))
        text = "".join(parts)
        return text[1:] if start and text.startswith(" ") else text


def pieces_of(text: str, most: int = 1_000_000) -> Iterator[str]:
    """The text with its leading space mark, cut into runs of about ``most`` characters before a space that follows a non-space."""
    text = " " + text.replace(SPACE, " ")
    at = 0
    while len(text) - at > most:
        cut = at + most
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or text[cut - 1] != " ":
                break
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Codec:
    """Encodes texts slice by slice and remembers the segments it has met, up to a fixed size."""

    def __init__(self, model_file: str, keep_ids: bool = True, most_chars: int = 6_000_000, most_segments: int = 400_000):
        self.model = MergeModel(model_file)
        self.keep_ids = keep_ids
        self.most_chars, self.most_segments = most_chars, most_segments
        self.known: dict[str, tuple] = {}
        self.chars = 0

    def learn(self, segments: set[str]) -> None:
        new = [s for s in segments if s not in self.known]
        if self.chars + sum(map(len, new)) > self.most_chars or len(self.known) + len(new) > self.most_segments:
            self.known, self.chars = {}, 0
            new = list(segments)
        self.chars += sum(map(len, new))
        number, text_of, plain = self.model.number.__getitem__, self.model.text_of.__getitem__, self.model.plain
        for s, ids in zip(new, self.model.encode_segments(new), strict=True):
            text = "".join(map(text_of, ids)) if plain.issuperset(ids) else self.model.decode_ids(ids, start=False)
            self.known[s] = (len(ids), ",".join(map(number, ids)), s if text == s else text, ids if self.keep_ids else None)

    def rows(self, texts: list[str | None], wanted: list[str]) -> Iterator[tuple]:
        """The wanted outputs of each text, in slices of about 500,000 characters."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= 500_000):
                chars += len(texts[end] or "")
                end += 1
            yield from self._slice(texts[at:end], wanted)
            at = end

    def _slice(self, texts: list[str | None], wanted: list[str]) -> Iterator[tuple]:
        if len(texts) > 1:
            cut = [self._segments(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
            self.learn(set().union(*cut))
            for segments in cut:
                yield self._assemble([segments], wanted)
        else:
            yield self._assemble(self._long(texts[0]), wanted)

    def _long(self, text: str | None) -> Iterator[list[str]]:
        for part in pieces_of(text) if text else ():
            segments = self._segments(part)
            self.learn(set(segments))
            yield segments

    def _segments(self, text: str) -> list[str]:
        return [p for s in SEGMENT.findall(text) for p in (self.model.parts(s) if len(s) > LONG else (s,))]

    def _assemble(self, parts: Iterable[list[str]], wanted: list[str]) -> tuple:
        n, ids, texts = 0, [], []
        ids_sha, text_sha = hashlib.sha256(), hashlib.sha256()
        begun = False
        for segments in parts:
            found = list(zip(*map(self.known.__getitem__, segments), strict=True))
            n += sum(found[0]) if found else 0
            if "ids" in wanted and found:
                ids.extend(i for x in found[3] for i in x)
            if "ids_sha256" in wanted and found:
                ids_sha.update(("," * begun + ",".join(found[1])).encode())
            if found and ("decoded" in wanted or "decoded_sha256" in wanted):
                text = "".join(found[2])
                text = text if begun else text[1:]  # the first segment begins with the added space
                text_sha.update(text.encode())
                if "decoded" in wanted:
                    texts.append(text)
            begun = begun or bool(found)
        out = {"n_tokens": n, "ids": ids, "decoded": "".join(texts), "ids_sha256": ids_sha.hexdigest(), "decoded_sha256": text_sha.hexdigest()}
        return tuple(out[w] for w in wanted)


def encode(docs: DataFrame, model_file: str, outputs: Iterable[str] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and the outputs asked for, of OUTPUTS."""
    wanted = list(outputs)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_file, keep_ids="ids" in wanted)
        for batch in batches:
            step = 2000
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                got = list(zip(*codec.rows(part.column(1).to_pylist(), wanted), strict=True))
                columns = [part.column(0), *(pa.array(list(v), OUTPUTS[w][1]) for w, v in zip(wanted, got, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *wanted])

    schema = ", ".join([f"id {kind}", *(f"{w} {OUTPUTS[w][0]}" for w in wanted)])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids (null: the empty text)."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = MergeModel(model_file)
        for ids in batches:
            yield ids.map(lambda x: "" if x is None else model.decode_ids(x.tolist()))

    return rows.withColumn(out_col, text_of(F.col(ids_col)))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded with the 32k piece model."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256"))
