"""Language identification by prediction by partial matching (operator 10).

Each language has a byte context tree: after white space has been folded, a text is a row of tokens, each
a word with a space before and after it, and the context of a byte is up to ``ORDER`` bytes before it in
its token.  A byte's code length under a tree follows PPM method C with frozen statistics: from the
longest context on, a context that was seen but not with this byte costs its escape, an unseen context
costs nothing, and below order 0 all 256 bytes are equally likely.  A text's code length is the exact
sum over its bytes; the language with the shortest wins (ties: the smaller name).  As contexts do not
reach over spaces, a word's code lengths depend on the word alone and are remembered.

The trees are fitted on a bounded sample of labelled rows: about ``docs_per_lang`` documents of each
language, those with the smallest hash of their id.  Prediction reads every text whole, without a shuffle.

Defined results: a null text, or one without any letter, is ``und`` with score 0; with no labelled rows
every text is ``und``; the score is the winner's share of the posterior for equal priors; other columns,
ids and repeated rows play no part in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 4
DOCS_PER_LANG = 1500
#: Most languages scored at once, and so the most that is broadcast together: the trees of one are a few megabytes.
MOST_LANGS = 200
LETTER = regex.compile(r"\p{L}")
SHORT = 48


def _contexts(data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte but a token's first space: its context of that many bytes and itself as one number; whether the token has so many bytes before it.

    data: tokens, each beginning with a space and followed by the next one's space."""
    n = len(data)
    key = data.astype(np.uint64)
    since = np.arange(n) - np.maximum.accumulate(np.where(data == 32, np.arange(n), 0))
    at_space = data == 32
    since[at_space] = np.r_[0, since[:-1][at_space[1:]] + 1] if at_space[0] else since[at_space]
    for k in range(1, min(order, n - 1) + 1):
        key[k:] |= data[: n - k].astype(np.uint64) << np.uint64(8 * k)
    return key | np.uint64(1) << np.uint64(8 * (order + 1)), since >= order


class Tree:
    """Context counts: sorted keys (a length mark, the context and a byte) and how often each was met."""

    @staticmethod
    def count(texts: Iterator[str]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for t in texts:
            words = t.encode().split()
            if not words:
                continue
            data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
            new = []
            for order in range(ORDER + 1):
                k, ok = _contexts(data, order)
                ok[0] = False
                new.append(k[ok])
            got, m = np.unique(np.concatenate(new), return_counts=True)
            keys, n = np.concatenate([keys, got]), np.concatenate([n, m])
            if len(keys) > 2_000_000:
                keys, n = Tree.merge(keys, n)
        return Tree.merge(keys, n)

    @staticmethod
    def merge(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return keys, n
        by = np.argsort(keys, kind="stable")
        keys, n = keys[by], n[by]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[at], np.add.reduceat(n, at)


class Forest:
    """The trees of all languages over the union of their contexts, with every fallback worked out beforehand.

    ``bits[o]`` holds, for each context and byte that any language met at order o, each language's final code
    length; ``escapes[o]`` holds for each context what a byte costs a language that knows the context when none
    met that byte in it.  So most bytes need a single search."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.keys, self.bits, self.contexts, self.escapes = [], [], [], []
        for order in range(ORDER + 1):
            low, high = np.uint64(1) << np.uint64(8 * (order + 1)), np.uint64(1) << np.uint64(8 * (order + 2))
            own = []
            for x in self.langs:
                k, n = counts[x]
                at = slice(*np.searchsorted(k, [low, high]))
                own.append((k[at], n[at]))
            keys = np.unique(np.concatenate([k for k, _ in own]))
            contexts = np.unique(keys >> np.uint64(8))
            bits, escapes = np.full((len(keys), len(own)), np.nan), np.zeros((len(contexts), len(own)))
            for j, (k, n) in enumerate(own):
                if not len(k):
                    continue
                c, at, distinct = np.unique(k >> np.uint64(8), return_index=True, return_counts=True)
                total = np.add.reduceat(n, at)
                bits[np.searchsorted(keys, k), j] = -np.log2(n / np.repeat(total + distinct, distinct))
                escapes[np.searchsorted(contexts, c), j] = -np.log2(distinct / (total + distinct))
            fall = escapes[np.searchsorted(contexts, keys >> np.uint64(8))]
            if order:
                mask = (np.uint64(1) << np.uint64(8 * order)) - np.uint64(1)
                fall = fall + self.bits[-1][np.searchsorted(self.keys[-1], keys & mask | mask + np.uint64(1))]
            else:
                fall = fall + 8.0
            self.keys.append(keys)
            self.bits.append(np.where(np.isnan(bits), fall, bits))
            self.contexts.append(contexts)
            self.escapes.append(escapes)

    def code_lengths(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte, for each language."""
        out = np.zeros((len(data), len(self.langs)))
        open_ = np.arange(len(data))
        for order in range(ORDER, -1, -1):
            key, ok = _contexts(data, order)
            here = open_[ok[open_]]
            k = key[here]
            at = np.minimum(np.searchsorted(self.keys[order], k), len(self.keys[order]) - 1)
            seen = self.keys[order][at] == k
            out[here[seen]] += self.bits[order][at[seen]]
            miss, c = here[~seen], k[~seen] >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[order], c), len(self.contexts[order]) - 1)
            known = self.contexts[order][at] == c
            out[miss[known]] += self.escapes[order][at[known]]
            done = np.zeros(len(data), bool)
            done[here[seen]] = True
            open_ = open_[~done[open_]]
        out[open_] += 8.0
        return out


class Model:
    """Trees of all languages; remembers words' code lengths, up to a fixed number."""

    def __init__(self, forest: Forest, most_words: int = 300_000):
        self.forest, self.langs = forest, forest.langs
        self.most_words = most_words
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(self.langs)))

    def score_words(self, words: list[bytes]) -> np.ndarray:
        """Code length of each word and the space after it, for each language."""
        out = np.empty((len(words), len(self.langs)))
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) < 8_000_000 // max(8, len(self.langs))):
                size += len(words[end]) + 1
                end += 1
            data = np.frombuffer(b" " + b" ".join(words[at:end]) + b" ", np.uint8)
            lengths = np.fromiter(map(len, words[at:end]), np.int64, end - at) + 1
            begins = np.r_[0, np.cumsum(lengths)[:-1]]
            out[at:end] = np.add.reduceat(self.forest.code_lengths(data)[1:], begins, axis=0)
            at = end
        return out

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > self.most_words:
            self.rows, new = {}, list(words)
        n = len(self.rows)
        if n + len(new) > len(self.table):
            self.table = np.resize(self.table, (max(2 * len(self.table), n + len(new)), len(self.langs)))
        for at in range(0, len(new), 1 << 16):
            part = new[at : at + (1 << 16)]
            self.table[n + at : n + at + len(part)] = self.score_words(part)
        self.rows.update(zip(new, range(n, n + len(new)), strict=True))

    def bits(self, texts: list[str | None]) -> np.ndarray:
        """Code length of each text for each language."""
        out = np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(texts):
            end, chars, cut = at, 0, []
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= 500_000):
                chars += len(texts[end] or "")
                cut.append((texts[end] or "").encode().split())
                end += 1
            self.learn({w for words in cut for w in words if len(w) <= SHORT})
            for k, words in enumerate(cut):
                short = [self.rows[w] for w in words if len(w) <= SHORT]
                if short:
                    out[at + k] = self.table[short].sum(axis=0)
                if len(short) < len(words):
                    out[at + k] += self.score_words([w for w in words if len(w) > SHORT]).sum(axis=0)
            at = end
        return out


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Context counts of each language, from about docs_per_lang of its rows with text."""
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.lit(10)).alias("h"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    # a row a language, of which the model has a tree each
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / n)))])
    # the share is even over all rows, so that a sample holds docs_per_lang rows but for chance
    sample = rows.where(F.pmod(F.col("h"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")

    def count(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                new = Tree.count(iter(part["text"]))
                old = held.get(lang)
                held[lang] = new if old is None else Tree.merge(np.concatenate([old[0], new[0]]), np.concatenate([old[1], new[1]]))
        for lang, (k, n) in held.items():
            yield pd.DataFrame({"lang": [lang], "k": [k.tobytes()], "n": [n.astype(np.int64).tobytes()]})

    def add(key, pdf):
        k, n = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("k", np.uint64), ("n", np.int64)))
        k, n = Tree.merge(k, n)
        return pd.DataFrame({"lang": [key[0]], "k": [k.tobytes()], "n": [n.tobytes()]})

    schema = "lang string, k binary, n binary"
    got = sample.mapInPandas(count, schema).groupBy("lang").applyInPandas(add, schema).collect()
    return {r["lang"]: (np.frombuffer(r["k"], np.uint64), np.frombuffer(r["n"], np.int64)) for r in got if len(r["k"])}


def _group_scores(spark, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
    """A function from a text column to struct<lang, bits, total>: the language of the shortest code, its length, and the sum of all codes' likelihoods as multiples of its own; nulls for a text without letters."""
    sent = spark.sparkContext.broadcast(Forest(counts))

    @F.pandas_udf("lang string, bits double, total double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(sent.value)
        for texts in batches:
            values = [None if t is None else t for t in texts]
            letters = np.array([t is not None and LETTER.search(t) is not None for t in values], bool)
            bits = model.bits([t if ok else None for t, ok in zip(values, letters, strict=True)])
            gap = np.minimum((bits - bits.min(axis=1, keepdims=True)) * np.log(2), 700)
            total = np.exp(-gap).sum(axis=1)
            yield pd.DataFrame({"lang": np.where(letters, np.array(model.langs, object)[bits.argmin(axis=1)], None), "bits": np.where(letters, bits.min(axis=1), np.nan), "total": np.where(letters, total, np.nan)})

    return scores


def predicted(found: list[Column]) -> Column:
    """struct<lang_pred, score> of what groups of languages have scored: the language of the shortest code of all, of equal ones the first group's, and its likelihood's share."""
    best = F.least(*[c["bits"] for c in found]) if len(found) > 1 else found[0]["bits"]
    of_all = sum((c["total"] * F.exp(-F.least((c["bits"] - best) * float(np.log(2)), F.lit(700.0))) for c in found), F.lit(0.0))
    lang = F.coalesce(*[F.when(c["bits"] == best, c["lang"]) for c in found])
    none = found[0]["lang"].isNull()
    return F.struct(F.when(none, "und").otherwise(lang).alias("lang_pred"), F.when(none, 0.0).otherwise(1 / of_all).alias("score"))


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; never for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predict(docs: DataFrame, counts: dict[str, tuple[np.ndarray, np.ndarray]], text_col: str = "text") -> Column:
    """Column struct<lang_pred, score> over docs.  Languages are scored ``MOST_LANGS`` at a time, however many there are."""
    langs = sorted(counts)
    if not langs:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    groups = [langs[k : k + MOST_LANGS] for k in range(0, len(langs), MOST_LANGS)]
    found = [_group_scores(docs.sparkSession, {lang: counts[lang] for lang in group})(F.col(text_col).cast("string")) for group in groups]
    # each group's scores are made once, and then looked at several times
    return F.transform(F.array(F.array(*found)), lambda own: predicted([own[k] for k in range(len(found))]))[0]


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents, from trees fitted on rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = fit(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(docs, counts).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
