"""Secrets, licenses, token counts and languages against plain versions."""

import base64
import re

import public_tokenizers
import pytest

from weir.llm import decontaminate, language_id, licenses, secrets, token_counts

# Families that the others say little of: bare access keys, of which two in three are found, and three that only their own findings tell.
LEAST_RIGHT = {"AKIA": 0.6, "block": 0.0, "placeholder": 0.0, "named": 0.15}
PLANTED = re.compile(r'AKIA[A-Z0-9]{16}|(?i:password=([0-9a-f]{18})|token = "([0-9a-f]{40})")')


def test_secrets_found_and_harmless_values_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("n_secrets", secrets.F.lit("x"))
    want = {r.doc_id: sorted(m.span(m.lastindex or 0) for m in PLANTED.finditer(r.text or "")) for r in docs.collect()}
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.spans] for r in secrets.scan(docs, vocabulary).collect()}
    assert got == want
    rows = [(1, None), (2, ""), (2, ""), (None, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" end'), (4, "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b " + "word " * 50)]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in secrets.redact(small, vocabulary).collect()) == [("1", None), ("2", ""), ("2", ""), ("4", rows[4][1]), ("None", f'token = "{secrets.REDACTED}" end')]
    assert secrets.scan(small.limit(0), vocabulary).count() == 0


def test_labelled_findings_are_used(spark):
    rows = [("token=", f"abcdefgh{k}", "", True) for k in range(40)] + [("size=", f"abcdefgh{k}", "", False) for k in range(40)] + [(None, None, None, None)]
    labelled = spark.createDataFrame(rows, "left string, value string, right string, secret boolean")
    words = secrets.Dictionary(["word", "other"])
    forest = secrets.train(words, labelled)
    p = forest.predict(secrets.np.array([secrets.features("token=", "abcdefgh99", "", words), secrets.features("size=", "abcdefgh99", "", words)]))
    assert p[0] > 0.6 and p[1] < 0.4


@pytest.fixture(scope="module")
def words():
    return secrets.Dictionary.read(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def findings(words):
    """Families, features and labels of the stand-in findings, and of others drawn anew."""
    np = secrets.np

    def drawn(n, seed):
        rows = secrets.families_of_findings(n, seed)
        return np.array([f for f, _ in rows]), np.array([secrets.features(a, v, b, words) for _, (a, v, b, _) in rows]), np.array([float(y) for _, (*_, y) in rows])

    return drawn(6000, 5), drawn(3000, 77)


@pytest.mark.parametrize("family", secrets.SECRET_FAMILIES + secrets.PREFIX_FAMILIES + secrets.HARMLESS_FAMILIES)
def test_findings_of_a_shape_not_learnt_from(findings, family):
    """The forest against labelled findings of a family that it was fitted without, drawn anew."""
    (families, x, y), (new_families, new_x, new_y) = findings
    forest = secrets.Forest(x[families != family], y[families != family])
    mine = new_families == family
    right = float(((forest.predict(new_x[mine]) >= secrets.THRESHOLD) == new_y[mine]).mean())
    assert right >= LEAST_RIGHT.get(family, 0.9), (family, right)


def test_blocks_and_long_texts(words):
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    text = f"x {end} {begin}\nabc\n{begin} d {end} {end} {begin} open"
    plain = [m.span() for m in re.finditer(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", text)]
    assert secrets.blocks(text) == plain and len(plain) == 1
    # many beginnings without an end, many findings and one very long run, each in one pass
    scanner = secrets.Scanner(secrets.train(words), words)
    found = scanner.find([begin * 20_000, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" ' * 5_000, "a1B2" * 250_000, None, ""])
    assert [len(s) for _, s in found[1:2]] == [5_000] and found[3:] == [(0, []), (0, [])]


def test_licenses(spark):
    notice = licenses.TEMPLATES["Apache-2.0"]
    rows = [(1, "a b c " * 30 + notice.upper() + " d e f" * 30), (1, "a b c " * 30 + notice.upper() + " d e f" * 30), (2, None), (3, ""), (4, "licensed under"), (None, "All rights reserved."), (6, notice[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license_id", licenses.F.lit("x"))
    got = sorted((str(r.doc_id), r.license_id) for r in licenses.scan(docs, licenses.templates(spark)).collect())
    assert got == [("1", "Apache-2.0"), ("1", "Apache-2.0"), ("None", "reserved")]
    assert licenses.scan(docs.limit(0), licenses.templates(spark)).count() == 0
    assert licenses.scan(docs, licenses.templates(spark).limit(0)).count() == 0


def test_short_licenses_are_found_wherever_they_stand(spark):
    import random

    rng = random.Random(5)
    filler = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(900):
        name = ("reserved", "MIT-line", "CC-BY-4.0")[k % 3]
        rows.append((k, name, " ".join(filler(rng.randrange(60)) + [licenses.TEMPLATES[name]] + filler(rng.randrange(60)))))
    # the two halves of a notice far apart; five of its six shingles are left
    rows.append((900, "Apache-2.0", " ".join(["licensed under the apache license version", *filler(40), "apache license version 2 0"])))
    docs = spark.createDataFrame(rows, "doc_id long, name string, text string")
    got = sorted((r.doc_id, r.license_id) for r in licenses.scan(docs, licenses.templates(spark)).collect())
    assert got == sorted((i, name) for i, name, _ in rows)


def test_licenses_equal_brute_force(spark):
    """Every built-in notice, whole or with words changed, left out or put in, in texts of all lengths, very long ones too."""
    import random

    rng = random.Random(8)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    sets = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    filler = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for text in list(licenses.TEMPLATES.values()) * 40:
        w = split(text)
        for _ in range(rng.randrange(4) if len(w) > 8 else 0):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = filler(rng.randrange(2))
        rows.append((len(rows), " ".join(filler(rng.choice([0, 3, 50, 300])) + w + filler(rng.choice([0, 3, 50])))))
    rows.append((len(rows), " ".join(filler(200_000) + split(licenses.TEMPLATES["MIT-text"]) + ["x"] * 100_000)))
    templates = {k: sets(split(t)) for k, t in licenses.TEMPLATES.items()}
    want = sorted((i, k, round(len(t & s) / len(t), 9)) for i, text in rows for s in [sets(split(text))] for k, t in templates.items() if len(t & s) >= 0.8 * len(t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.license_id, round(r.containment, 9)) for r in licenses.scan(docs, licenses.templates(spark)).collect())
    assert got == want and len(want) > 700


@pytest.mark.parametrize(("name", "value"), [("MOST_WORDS", 0), ("LOOKED_AT", 0), ("BROADCAST_BYTES", -1)])
def test_licenses_beyond_each_bound(spark, monkeypatch, name, value):
    monkeypatch.setattr(licenses, name, value)
    test_licenses(spark)
    test_licenses_equal_brute_force(spark)


@pytest.mark.parametrize("piece", [200_000, 20])
def test_token_counts(spark, piece):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "a", "a  b \n\n c  ", "it's été 日本 123456 <|endoftext|>  x" * 9, "a", *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect())]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    n = sorted(len(encoder.encode_ordinary(t or "")) for t in texts)
    got = token_counts.with_suffix_sums(token_counts.histogram(token_counts.token_lengths(docs, path, public_tokenizers.PATTERN, piece=piece)))
    rows = {r.length: r for r in got.collect()}
    assert sorted(rows) == sorted(set(n))
    for length, r in rows.items():
        assert (r.n_docs, r.docs_longer, r.tokens_longer, r.tokens_total, r.tokens_cut) == (n.count(length), sum(x > length for x in n), sum(x for x in n if x > length), sum(n), sum(min(x, length) for x in n))
    limits = {r.limit: (r.docs_longer, r.tokens_cut) for r in token_counts.at_limits(got, [0, 7, 10**6]).collect()}
    assert limits == {x: (sum(y > x for y in n), sum(min(y, x) for y in n)) for x in (0, 7, 10**6)}
    half = token_counts.quantiles(got, [0.5]).first()["length"]
    assert half == min(x for x in n if 2 * sum(y <= x for y in n) >= len(n))
    assert token_counts.with_suffix_sums(token_counts.histogram(token_counts.token_lengths(docs.limit(0), path, public_tokenizers.PATTERN))).count() == 0


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = language_id.fit(docs.where(~language_id.held_out(language_id.F.col("doc_id"))))
    rows = docs.where(language_id.held_out(language_id.F.col("doc_id"))).select("lang", language_id.predict(docs, counts).alias("p")).collect()
    assert sum(r.lang == r.p.lang_pred for r in rows) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(None,), ("",), ("123 !?",), ("the and of the",)], "text string")
    got = [(r.p.lang_pred, r.p.score) for r in odd.select(language_id.predict(odd, counts).alias("p")).collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[3][0] == "en" and 0 < got[3][1] <= 1
    assert [r.p.lang_pred for r in odd.select(language_id.predict(odd, {}).alias("p")).collect()] == ["und"] * 4
    assert language_id.fit(docs.limit(0)) == {}


def test_languages_scored_in_groups(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = language_id.fit(docs)
    assert len(counts) >= 4
    scored = lambda: {r.doc_id: r.p for r in docs.select("doc_id", language_id.predict(docs, counts).alias("p")).collect()}
    whole = scored()
    monkeypatch.setattr(language_id, "MOST_LANGS", 1)
    apart = scored()
    assert {i: p.lang_pred for i, p in apart.items()} == {i: p.lang_pred for i, p in whole.items()}
    assert all(abs(apart[i].score - p.score) < 1e-9 for i, p in whole.items())


def test_code_lengths_are_exact():
    import math

    def train(texts):
        counts = {}
        for t in texts:
            for w in t.encode().split():
                tok = b" " + w + b" "
                for i in range(1, len(tok)):
                    for o in range(min(language_id.ORDER, i) + 1):
                        c = counts.setdefault(tok[i - o : i], {})
                        c[tok[i]] = c.get(tok[i], 0) + 1
        return counts

    def bits(counts, t):
        out = 0.0
        for w in t.encode().split():
            tok = b" " + w + b" "
            for i in range(1, len(tok)):
                for o in range(min(language_id.ORDER, i), -1, -1):
                    c = counts.get(tok[i - o : i])
                    if c is None:
                        continue
                    n, kinds = sum(c.values()), len(c)
                    if tok[i] in c:
                        out -= math.log2(c[tok[i]] / (n + kinds))
                        break
                    out -= math.log2(kinds / (n + kinds))
                else:
                    out += 8
        return out

    en, de = ["the cat sat on the mat é", "abab the  then", "x"], ["der die das und", "ein über"]
    model = language_id.Model(language_id.Forest({"en": language_id.Tree.count(iter(en)), "de": language_id.Tree.count(iter(de))}))
    texts = ["the den cat", "zzz é über  q", "a" * 100 + " the", "", "x", "the the mat über"]
    want = [[bits(train(de), t), bits(train(en), t)] for t in texts]
    assert abs(model.bits(texts) - language_id.np.array(want)).max() < 1e-9


def test_decontamination_shares_and_clashing_columns(spark):
    """A share is met exactly, and columns may have any names."""
    item = " ".join(f"b{k}" for k in range(13))
    rows = [(k, f"{item} " + "x " * k, "a", "b", "c", "d") for k in (73, 74, 420, 421)] + [(5, None, "a", "b", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, __KEY string, __spans string, __parts string")
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    left = lambda share: sorted(r.doc_id for r in decontaminate.remove_contaminated(docs, bench, share).collect())
    assert left(0.15) == [5, 74, 420, 421] and left(0.03) == [5, 421]
    cut = decontaminate.remove_spans(docs, bench)
    assert cut.columns == docs.columns
    assert {r.doc_id: (r.text or "").split() for r in cut.collect()} == {i: ["x"] * i if i != 5 else [] for i in (73, 74, 420, 421, 5)}
    assert decontaminate.remove_spans(docs.limit(0), bench).count() == 0 and decontaminate.remove_contaminated(docs.limit(0), bench).count() == 0
