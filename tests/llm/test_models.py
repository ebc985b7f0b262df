"""SentencePiece, the class model, decontamination and the pipeline against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from weir.llm import brown_lm, decontaminate, sentencepiece_bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(0)
    letters = "  ab etion\n\t▁ée日本🙂\x00<s>0x"
    out = [None, "", " ", "   ", "a" * 1000, " " * 500, "▁▁a", "﻿"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return out + ["".join(rng.choice(["the", "tion", " ", "in", "an", "aaa", "  ", "er", "ing"]) for _ in range(40)) for _ in range(1000)]


def test_ids_and_texts_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts() + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    wanted = ["n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"]
    for text, got in zip(texts, sentencepiece_bpe.Codec(MODEL).rows(texts, wanted), strict=True):
        ids = library.encode(text or "")
        decoded = library.decode(ids)
        assert got == (len(ids), ids, decoded, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_long_texts_are_cut_without_effect():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "  the  lonely   words 日本 " * 400
    assert "".join(sentencepiece_bpe.pieces_of(text, 50)) == " " + text
    codec = sentencepiece_bpe.Codec(MODEL, most_segments=3)
    assert list(codec.rows([text, None, text], ["ids"])) == [(library.encode(text),), ([],), (library.encode(text),)]


def test_long_texts_without_spaces():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    letters = [*"abcdefghijklmnopqrstuvwxyz0123456789", "日", "本", "é", "🙂", "\n"]
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (399, 401, 5_000, 60_000)]
    texts += ["日本語" * 20_000, "the" * 700, "x" * 900 + " " + "tion" * 300, "https://a.example/" + "q9" * 600]
    got = sentencepiece_bpe.Codec(MODEL).rows(texts, ["ids", "decoded"])
    for text, (ids, decoded) in zip(texts, got, strict=True):
        assert ids == library.encode(text) and decoded == library.decode(ids)


def test_encode_and_decode_frames(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string").withColumn("n_tokens", sentencepiece_bpe.F.lit("x"))
    rows = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, MODEL, ["n_tokens", "ids"]), MODEL)
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded) for r in rows.collect()) == [("1", 2, "a b"), ("1", 2, "a b"), ("None", 0, "")]
    assert sentencepiece_bpe.encode(docs.limit(0), MODEL).count() == 0


EXTRA = [(None, "the unheardof word"), (None, "the"), (10**6, None), (10**6 + 1, "the the"), (10**6 + 1, "the the"), (10**6 + 2, ""), (10**6 + 3, "long " * 60_000 + "tale")]


@pytest.mark.parametrize("core_share", [5e-6, 2e-3])
def test_class_model(spark, core_share):
    """Counts, class bigrams and scores against plain versions, with every repeated word in the core and with most outside it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(EXTRA, "doc_id long, text string")).withColumn("n_tokens", brown_lm.F.lit("x")).withColumn("word", brown_lm.F.lit(1))
    out = brown_lm.held_out(brown_lm.F.col("doc_id"))
    model = brown_lm.train(rows, out, classes=8, core_share=core_share)
    got = brown_lm.score(model).collect()
    texts = [(r.doc_id, brown_lm.tokens(r.text)) for r in rows.collect()]
    is_out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, ws in texts if not is_out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), is_out(i), len(ws), sum(counts[w] > 0 for w in ws), n, math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in texts)
    found = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [r[:5] for r in found] == [r[:5] for r in want] and [r[5] for r in found] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    # every word met twice has a class of its own choice; the others that of their shape
    named = {brown_lm.name(w): w for w in counts}
    assert len(named) == v
    core = {named[w]: int(model.classes[k]) for w, k in model.vocab.ids().items()}
    rest = {named[r.h, r.mark]: (r.n, r["class"]) for r in model.rest.collect()}
    assert {w: m for w, (m, _) in rest.items()} == {w: m for w, m in counts.items() if w not in core}
    assert all((1 <= c <= 8) if m > 1 else c is None for m, c in rest.values()) and len(rest) > 100
    of_shape = lambda w: 9 + brown_lm.shape(w)
    seen_as = lambda w: core.get(w, of_shape(w))
    class_of = lambda w: core[w] if w in core else rest[w][1] or of_shape(w) if w in rest else of_shape(w)
    table = Counter((seen_as(a), class_of(b)) for i, ws in texts if not is_out(i) for a, b in zip([brown_lm.END, *ws], ws, strict=False))
    assert {(a, b): int(model.table[a, b]) for a, b in zip(*model.table.nonzero(), strict=True)} == table
    # the classes' transitions and each class's words are distributions
    assert (10**model.log_next).sum(axis=1) == pytest.approx(1)
    tokens_of, once, twice = model.table.sum(axis=0), Counter(), Counter()
    for w, m in counts.items():
        (once if m == 1 else twice if m == 2 else Counter())[of_shape(w) if w != brown_lm.END else 0] += 1
    share = lambda c: (once[c] + 1) / (once[c] + 2 * twice[c] + 2)
    emit = lambda w: counts[w] / tokens_of[class_of(w)] if counts[w] > 1 else (1 - share(of_shape(w))) / once[of_shape(w)] if counts[w] else share(of_shape(w))
    want = sorted((str(i), math.fsum(model.log_next[seen_as(a), class_of(b)] + math.log10(emit(b)) for a, b in zip([brown_lm.END, *ws], ws, strict=False))) for i, ws in texts)
    assert [x for _, x in sorted((str(r.doc_id), r.score) for r in got)] == pytest.approx([x for _, x in want], rel=1e-9)


def test_words_of_one_hash_are_kept_apart():
    """Rows of gathered words whose 64-bit hashes are equal by chance, over several batches."""
    np, pa = brown_lm.np, brown_lm.pa
    rows = [(5, k, (k % 3) | (k == 7) << 16 | (1 + k % 2) << 32) for k in range(12)] + [(6, 99, 1 | 7 << 32)]
    batches = [pa.table({c: pa.array([r[i] for r in part], pa.int64()) for i, c in enumerate(("h", "key", "mark"))}).to_batches()[0] for part in (rows[:5], rows[5:])]
    got = [r for b in brown_lm._gathered(iter(batches)) for r in b.to_pylist()]
    read = lambda r: (r["h"], r["mark"], r["n"], *(np.frombuffer(r[c], t).tolist() for c, t in (("g", np.uint16), ("m", np.int64), ("keys", np.int64), ("before", np.uint16))))
    assert sorted(map(read, got)) == [(5, 1, 6, [0, 1, 2], [2, 2, 2], [0, 2, 4, 6, 8, 10], [0, 2, 1, 0, 2, 1]), (5, 2, 5, [0, 1, 2], [2, 1, 2], [1, 3, 5, 7, 9, 11], [1, 0, 2, 1, 0, 2]), (6, 7, 1, [1], [1], [99], [1])]


def test_class_model_without_texts(spark):
    rows = spark.createDataFrame(EXTRA, "doc_id long, text string")
    every = brown_lm.F.lit(True)
    got = brown_lm.score(brown_lm.train(rows, every, classes=4)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * len(EXTRA) and sorted(r.n_tokens for r in got) == [1, 1, 2, 3, 3, 4, 60_002]
    assert brown_lm.score(brown_lm.train(rows.limit(0))).count() == 0


def test_exchange_of_the_rest_takes_the_best_move(spark):
    """Each word's move against the likelihood of the whole table, tried for every class."""
    np = brown_lm.np
    rng = np.random.default_rng(1)
    k, free_ = 6, 3
    table = rng.integers(0, 60, (k, k)).astype(float)
    words = [(b"w%d" % i, np.unique(rng.integers(0, k, 3)), int(rng.integers(1, 6))) for i in range(40)]
    rows = [(w, g, rng.integers(1, 12, len(g)), c) for w, g, c in words]
    for _, g, m, c in rows:
        np.add.at(table, (g, c), m)
    exchange = brown_lm._Exchange(free_, [(table, 0, 1)])
    into, more = exchange.costs[0]
    sizes = np.array([len(r[1]) for r in rows])
    own = np.array([r[3] for r in rows])
    n = np.array([r[2].sum() for r in rows], float)
    got = exchange._round(table, into, more, own, n, np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]), np.r_[0, np.cumsum(sizes)], np.ones(len(rows), bool))
    for (_, g, m, c), to in zip(rows, got, strict=True):
        tried = {}
        for d in ([] if c > free_ else [c]) + list(range(1, free_ + 1)):
            t = table.copy()
            np.add.at(t, (g, c), -m)
            np.add.at(t, (g, d), m)
            tried[d] = brown_lm.likelihood(t)
        assert tried[to] >= max(tried.values()) - 1e-6


def plain_hits(text, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        iw = words(t)
        for k in range(max(1, len(iw) - window + 1)) if iw else ():
            g = iw[k : k + window]
            for a in range(len(w) - len(g) + 1):
                if w[a : a + len(g)] == g:
                    hit.update(range(a, a + len(g)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    item = " ".join(f"q{k}" for k in range(20))
    items = [(1, item), (2, "Short one"), (3, None), (10, "short ONE"), (4, "!!")]
    rows = [(1, None), (2, ""), (3, item.upper()), (3, item.upper()), (None, "a short, one b " * 3), (5, "x " * 500 + item), (6, "été short one"), (7, "short" * 3), (8, " ".join(f"q{k}" for k in range(12)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", decontaminate.F.lit("x"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.judged(docs, benchmark).collect())
    want = sorted((str(i), n, h, f, h > 0 and 20 * h >= n) for i, t in rows for n, h, f in [plain_hits(t, items)])
    assert got == want
    kept = [r.doc_id for r in decontaminate.remove_contaminated(docs, benchmark).collect()]
    assert sorted(kept) == [1, 2, 5, 7, 8]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs.where("doc_id in (5, 6)"), benchmark).collect()}
    assert cut == {5: "x " * 500, 6: "été "}
    assert decontaminate.judged(docs.limit(0), benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.judged(docs, benchmark.limit(0)).collect())
    # beyond the size that is broadcast the result is the same
    decontaminate.BROADCAST_WINDOWS, most = 0, decontaminate.BROADCAST_WINDOWS
    try:
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.judged(docs, benchmark).collect()) == want
    finally:
        decontaminate.BROADCAST_WINDOWS = most


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    from tests.llm.test_near_dup import brute

    texts = {r.doc_id: r.text for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    first = {i for i, (_, c) in brute(list(texts.items())).items() if i == c}
    clean = {i for i in first if not (lambda n, h, _: h > 0 and 20 * h >= n)(*plain_hits(texts[i], items))}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    secret = re.compile(r'(AKIA[A-Z0-9]{16})|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}', re.I)
    want = {i: library.encode(secret.sub("<secret>", texts[i])) for i in clean}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(want)
    assert got == want
