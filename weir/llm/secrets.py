"""Secret scans with a random forest against false positives (operator 3).

Candidates are values after ``=`` or ``:``, long runs of key characters, and private key blocks.  A random
forest, trained from labelled findings, judges each by its length, the transitions between its characters,
how much of it dictionary words cover, the path it is assigned to, and the words around it.

The labelled findings are a parameter: rows (left, value, right, secret).  At most ``MOST_FINDINGS`` of them
are used for the fit, those with the smallest hash; without any, findings made from fixed templates stand in, as
no table of labelled findings is given.
The dictionary is a vocabulary file's words, so its size is fixed.  The forest is small and is broadcast;
texts are scanned whole, in one pass without a shuffle.

Defined results: null and empty texts hold nothing and stay as they are; overlapping candidates are judged
from the longest on, and the first that counts wins; repeated rows and null ids stay rows of their own;
empty tables give empty results; redaction leaves all other columns as they are.
"""

from __future__ import annotations

import bisect
import json
import math
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_FINDINGS = 20_000
TREES, DEPTH = 40, 9
THRESHOLD = 0.5
CONTEXT = 60
REDACTED = "<secret>"

ASSIGNED = re.compile(r"""[:=]\s{0,3}["'`]?([^\s"'`,;<>()\[\]{}]{8,})""")
RUN = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
BEGIN, FINISH = (re.compile(rf"-----{word} [A-Z ]{{0,60}}PRIVATE KEY-----") for word in ("BEGIN", "END"))
PATH = re.compile(r"([\w.\-/\[\]]*)[\"'`\]]{0,2}\s{0,3}(?::=|=>|[:=])?\s{0,3}[\"'`]?$")
WORD = re.compile(r"[A-Za-z]+")
# Words that speak for and against a secret.
SECRET_WORDS = ("secret", "token", "key", "password", "passwd", "pwd", "credential", "auth", "bearer", "private", "access", "api")
HARMLESS_WORDS = ("example", "sample", "test", "dummy", "fake", "placeholder", "your", "changeme", "xxxx", "uuid", "guid", "sha", "md5", "hash", "checksum", "commit", "digest", "id", "url", "http", "mail", "version", "integrity")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "eyJ", "glpat-", "npm_", "SG.", "sk-")


class Dictionary:
    """Words of a vocabulary and the transitions between their letters."""

    def __init__(self, words: Iterable[str]):
        self.words = {w for w in words if len(w) >= 4}
        self.longest = max(map(len, self.words), default=0)
        counts = np.ones((27, 27))
        for w in self.words:
            code = [ord(c) - 97 for c in w]
            for a, b in zip([26, *code], [*code, 26], strict=True):
                counts[a, b] += 1
        self.log = np.log2(counts / counts.sum(axis=1, keepdims=True)).tolist()

    @classmethod
    def read(cls, vocabulary_json: str) -> Dictionary:
        with open(vocabulary_json, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        words = (w.removesuffix("</w>") for w in vocab if w.endswith("</w>"))
        return cls(w for w in words if w.isascii() and w.isalpha() and w.islower())

    def coverage(self, value: str) -> float:
        """Share of the characters in words, longest first from the left."""
        low, at, covered = value.lower(), 0, 0
        while at < len(low):
            for size in range(min(self.longest, len(low) - at), 3, -1):
                if low[at : at + size] in self.words:
                    covered += size
                    at += size
                    break
            else:
                at += 1
        return covered / max(1, len(low))

    def transition(self, value: str) -> float:
        """Mean log probability of the letters' transitions."""
        total, n, last = 0.0, 0, 26
        for c in value.lower():
            now = ord(c) - 97 if "a" <= c <= "z" else 26
            total += self.log[last][now]
            n += 1
            last = now
        return total / max(1, n)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(left: str, value: str, right: str, words: Dictionary) -> list[float]:
    """The forest's input of one candidate with up to CONTEXT characters before and after it."""
    n = len(value)
    counts = [0, 0, 0, 0]
    for c in value:
        counts[_kind(c)] += 1
    kinds = [_kind(c) for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    repeats = sum(a == b for a, b in zip(value, value[1:], strict=False)) / max(1, n - 1)
    steps = sum(ord(b) - ord(a) == 1 for a, b in zip(value, value[1:], strict=False)) / max(1, n - 1)
    entropy = -sum(m / n * math.log2(m / n) for m in map(value.count, set(value)))
    found = PATH.search(left)
    path = (found.group(1) if found else "").lower()
    low = value.lower()
    before = {w.lower() for w in WORD.findall(left[: len(left) - len(path)])[-4:]}
    after = {w.lower() for w in WORD.findall(right)[:3]}
    near = before | after
    tail = left.rstrip(" \"'`")[-1:]
    return [
        n, counts[0] / n, counts[1] / n, counts[2] / n, counts[3] / n, changes, repeats, steps, entropy, entropy / max(1.0, math.log2(n)),
        float(value.startswith(PREFIXES)),
        words.coverage(value), words.transition(value),
        float(any(w in path for w in SECRET_WORDS)), float(any(w in path for w in HARMLESS_WORDS)), len(path), float("/" in path or "/" in value),
        sum(w in SECRET_WORDS for w in near), sum(w in HARMLESS_WORDS for w in near), float(any(w in low for w in HARMLESS_WORDS)),
        float(tail in "=:" and tail != ""), float(left[-1:] in "\"'`" and left != ""), float("@" in value or right[:1] == "@" or left[-1:] == "@"), float("." in value),
        float(value.startswith("-----BEGIN")),
    ]


class Forest:
    """A random forest of binary trees by Gini impurity, as flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees = [self._tree(x, y, rng, depth) for _ in range(trees)]

    @staticmethod
    def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []
        pick = rng.integers(0, len(y), len(y))

        def grow(rows: np.ndarray, left: int) -> int:
            at, p = len(nodes), float(y[rows].mean())
            nodes.append([-1, 0.0, at, at, p])
            if left == 0 or p in (0.0, 1.0) or len(rows) < 4:
                return at
            best = (0.0, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
                by = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows[by], f], y[rows[by]]
                cut = np.flatnonzero(v[1:] > v[:-1])
                if not len(cut):
                    continue
                n, ones = len(t), np.cumsum(t)
                a = cut + 1.0
                pa_, pb = ones[cut] / a, (ones[-1] - ones[cut]) / (n - a)
                gain = p * (1 - p) - (a * pa_ * (1 - pa_) + (n - a) * pb * (1 - pb)) / n
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(f), float(v[cut[k]]))
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                nodes[at][0], nodes[at][1] = best[1], best[2]
                nodes[at][2] = grow(rows[low], left - 1)
                nodes[at][3] = grow(rows[~low], left - 1)
            return at

        grow(pick, depth)
        table = np.array(nodes)
        return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                down = np.where(x[rows, np.maximum(f, 0)] <= threshold[at], left[at], right[at])
                at = np.where(inner, down, at)
            total += share[at]
        return total / len(self.trees)


# The families of stand-in findings, of each kind in the order in which they are drawn.
SECRET_FAMILIES = ["hex", "letters", "symbols", "base64", "lower", "upper"]
PREFIX_FAMILIES = ["AKIA", "ghp_", "sk_live_", "xoxb-", "eyJ", "AIza", "block"]
HARMLESS_FAMILIES = ["uuid", "digest", "placeholder", "prose", "number", "url", "name", "path", "word", "mail", "rule", "named"]


def stand_in_findings(n: int = 6000, seed: int = 5, without: tuple[str, ...] = ()) -> list[tuple[str, str, str, bool]]:
    """Labelled findings from fixed templates: (left, value, right, secret); without those of the families named."""
    return [row for family, row in families_of_findings(n, seed) if family not in without]


def families_of_findings(n: int, seed: int) -> list[tuple[str, tuple[str, str, str, bool]]]:
    """The same, each with its family."""
    rng = np.random.default_rng(seed)
    letters, upper, digits = string.ascii_letters, string.ascii_uppercase + string.digits, string.digits
    made = lambda chars, size: "".join(chars[k] for k in rng.integers(0, len(chars), size))
    one = lambda xs: xs[int(rng.integers(0, len(xs)))]
    syllables = ["tion", "ver", "en", "an", "th", "er", "que", "mente", "ung", "re", "de", "ou", "in", "st", "al", "or"]
    word = lambda: "".join(one(syllables) for _ in range(int(rng.integers(1, 4))))
    text = lambda: " ".join(word() for _ in range(int(rng.integers(1, 5))))
    out = []
    for k in range(n):
        if k % 2:
            kind = int(rng.integers(0, 8))
            name = one(["token", "secret", "password", "api_key", "auth.token", "db_password", "client_secret", "access_key", "PRIVATE_TOKEN"])
            value = [made("0123456789abcdef", int(rng.integers(16, 65))), made(letters + digits, int(rng.integers(16, 49))), made(letters + digits + "!#%&*+-_", int(rng.integers(10, 25))), made(letters + digits + "+/", int(rng.integers(32, 65))), made(string.ascii_lowercase + digits, int(rng.integers(14, 41))), made(upper, int(rng.integers(14, 41)))]
            drawn = int(rng.integers(0, 6))
            value, family = value[drawn], SECRET_FAMILIES[drawn]
            if kind < 5:
                quote = one(["", '"', "'"])
                left, right = f"{text()} {name}{one(['=', ' = ', ': ', ':'])}{quote}", f"{quote} {text()}"
            else:
                value = one([f"AKIA{made(upper, 16)}", f"ghp_{made(letters + digits, 36)}", f"sk_live_{made(letters + digits, 24)}", f"xoxb-{made(digits, 11)}-{made(letters + digits, 24)}", f"eyJ{made(letters + digits, 80)}", f"AIza{made(letters + digits + '_-', 35)}", "-----BEGIN PRIVATE KEY-----\n" + made(letters + digits + "+/", 300) + "\n-----END PRIVATE KEY-----"])
                family = next((f for f in PREFIX_FAMILIES if value.startswith(f)), "block")
                left, right = f"{text()} ", f" {text()}"
            out.append((family, (left[-CONTEXT:], value, right[:CONTEXT], True)))
        else:
            kind = int(rng.integers(0, 16))
            kind = min(kind, 11)  # the last family, which has all shapes, is drawn as often as five others
            hexes = lambda m: made("0123456789abcdef", m)
            cases = [
                (f"{text()} {one(['id', 'uuid', 'request'])}: ", f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", f" {text()}"),
                (f"{one(['commit', 'sha1', 'sha256', 'checksum', 'md5'])}{one([' ', ': ', '='])}", hexes(one([32, 40, 64])), f" {text()}"),
                (f"{one(['password', 'token', 'api_key', 'secret'])}{one(['=', ': '])}", one(["your_api_key_here", "changeme123", "xxxxxxxxxxxxxxxx", "EXAMPLEKEY12345", "placeholder-token", "test_password_1", "<your-token>", "********", "os.environ.get", "process.env.TOKEN", "12345678", "aaaaaaaaaaaa"]), f" {text()}"),
                (f"{text()} ", "".join(word() for _ in range(5)) + one(["", ".", "tion"]), f" {text()}"),
                (f"{text()} ", made(digits, int(rng.integers(12, 20))), f" {text()}"),
                (f"{text()}: ", f"https://www.{word()}.example.com/{word()}/{made(digits, 4)}", f" {text()}"),
                (f"{text()} ", f"{word()}_{word()}_{word()}_{made(digits, 2)}", f" {text()}"),
                (f"{text()} ", f"{word()}/{word()}/{word()}-{made(digits, 3)}", f".html {text()}"),
                (f"{text()}: ", f"{word()}{word()}{word()}", f", {text()}"),
                (f"{text()} ", f"{word()}.{made(digits, 2)}", f"@mail.example.com {text()}"),
                (f"{text()} ", one(["-", "=", "_", "+"]) * int(rng.integers(16, 80)), f" {text()}"),
                # values of every shape a secret has, under names that secrets don't have
                (f"{text()} {one(['build_id', 'etag', 'revision', 'checksum', 'hash', 'sha', 'digest', 'image_id', 'session-id', 'version', 'color', 'order', 'user', 'title', 'trace', 'ref', 'commit', 'md5'])}{one(['=', ' = ', ': ', ':', ' '])}{one(['', '', chr(34)])}", one([hexes(int(rng.integers(12, 65))), made(letters + digits, int(rng.integers(12, 49))), made(string.ascii_lowercase + digits, int(rng.integers(12, 41))), made(upper, int(rng.integers(12, 25))), made(letters + digits + "+/", int(rng.integers(24, 65))), made(letters + digits + "!#%&*+-_", int(rng.integers(10, 25)))]), f"{one(['', '', chr(34)])} {text()}"),
            ]
            left, value, right = cases[kind]
            out.append((HARMLESS_FAMILIES[kind], (left[-CONTEXT:], value, right[:CONTEXT], False)))
    return out


def train(words: Dictionary, labelled: DataFrame | None = None, most: int = MOST_FINDINGS) -> Forest:
    """A forest from labelled(left, value, right, secret), at most ``most`` rows, or from the stand-in findings."""
    rows = None
    if labelled is not None:
        h = F.xxhash64("left", "value", "right", "secret")
        usable = labelled.where("value is not null and value <> '' and secret is not null")
        rows = [(r["left"] or "", r["value"], r["right"] or "", r["secret"]) for r in usable.orderBy(h, "value").limit(most).collect()]
    rows = rows or stand_in_findings()
    x = np.array([features(a, v, b, words) for a, v, b, _ in rows])
    return Forest(x, np.array([float(s) for *_, s in rows]))


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of private key blocks: from a beginning to the next end after it, in one pass however many have none."""
    ends = [m.span() for m in FINISH.finditer(text)]
    out, at, k = [], 0, 0
    for begin in BEGIN.finditer(text):
        while k < len(ends) and ends[k][0] < begin.end():
            k += 1
        if k == len(ends):
            break
        if begin.start() >= at:
            at = ends[k][1]
            out.append((begin.start(), at))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of candidate values, in order of their start; the longer first."""
    spans = set(blocks(text))
    spans.update(m.span(1) for m in ASSIGNED.finditer(text))
    for m in RUN.finditer(text):
        value = m.group()
        if value.startswith(PREFIXES) or (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
            spans.add(m.span())
    return sorted(spans, key=lambda s: (s[0], -s[1]))


class Scanner:
    def __init__(self, forest: Forest, words: Dictionary, threshold: float = THRESHOLD):
        self.forest, self.words, self.threshold = forest, words, threshold

    def find(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """For each text the number of candidates and the spans that count, with their scores."""
        spans = [candidates(t) if t else [] for t in texts]
        x = [features(t[max(0, a - CONTEXT) : a], t[a:b], t[b : b + CONTEXT], self.words) for t, s in zip(texts, spans, strict=True) for a, b in s]
        scores = iter(self.forest.predict(np.array(x)).tolist() if x else [])
        out = []
        for s in spans:
            scored = [(a, b, next(scores)) for a, b in s]
            # the longest first; kept spans stay in order, so only the two next to a span can overlap it
            kept: list[tuple[int, int, float]] = []
            for a, b, p in sorted((r for r in scored if r[2] >= self.threshold), key=lambda r: (r[0] - r[1], r[0])):
                k = bisect.bisect_left(kept, (a,))
                if (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or kept[k][0] >= b):
                    kept.insert(k, (a, b, round(p, 9)))
            out.append((len(s), kept))
        return out


def scanner(docs: DataFrame, vocabulary_json: str, labelled: DataFrame | None = None):
    """A function from a text column to struct<n_candidates, spans>; spans are in characters."""
    words = Dictionary.read(vocabulary_json)
    sent = docs.sparkSession.sparkContext.broadcast((train(words, labelled), words))

    @F.pandas_udf("n_candidates long, spans array<struct<start: int, end: int, score: double>>")
    def scan_(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Scanner(*sent.value)
        for texts in batches:
            found = own.find(list(texts))
            yield pd.DataFrame({"n_candidates": [n for n, _ in found], "spans": [[{"start": a, "end": b, "score": p} for a, b, p in s] for _, s in found]})

    return scan_


def scan(docs: DataFrame, vocabulary_json: str, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_candidates, n_secrets, spans (start, end, score)."""
    found = docs.select(F.col(id_col), scanner(docs, vocabulary_json, labelled)(F.col(text_col).cast("string")).alias("f"))
    return found.select(id_col, "f.n_candidates", F.size("f.spans").cast("long").alias("n_secrets"), "f.spans")


def redact(docs: DataFrame, vocabulary_json: str, labelled: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """docs with every secret in the text replaced by REDACTED."""
    words = Dictionary.read(vocabulary_json)
    sent = docs.sparkSession.sparkContext.broadcast((train(words, labelled), words))

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scanner(*sent.value)
        for texts in batches:
            out = []
            for t, (_, spans) in zip(texts, own.find(list(texts)), strict=True):
                for a, b, _ in reversed(spans):
                    t = t[:a] + REDACTED + t[b:]
                out.append(t)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col)))


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """The secrets in all documents, with what is left of each text as a digest of its spans."""
    import public_tokenizers

    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_candidates", "n_secrets", F.transform("spans", lambda s: s["start"]).alias("starts"), F.transform("spans", lambda s: s["end"]).alias("ends"), F.transform("spans", lambda s: s["score"]).alias("scores"))
