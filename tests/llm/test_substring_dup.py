import hashlib
import re
from collections import Counter

import pytest

from weir.llm import substring_dup


def brute(rows, window):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dup, "RANGE_BYTES", 100_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("key", substring_dup.F.lit(1))
    assert result(substring_dup.remove_repeats(docs, texts=False)) == brute([(r.doc_id, r.text) for r in docs.collect()], 35)


@pytest.mark.parametrize(("most", "hot"), [(0, 2_000), (0, 2), (48_000_000, 2)])
def test_small_windows_nulls_and_repeated_rows(spark, monkeypatch, most, hot):
    monkeypatch.setattr(substring_dup, "BROADCAST_BYTES", most)
    monkeypatch.setattr(substring_dup, "HOT", hot)
    a = " ".join(f"w{k}" for k in range(40))
    rows = [(1, None), (2, ""), (3, a), (3, a), (4, "x y " + " ".join(f"w{k}" for k in range(5, 17)) + " z"), (5, "p q r s t u v " * 5), (None, "a b c"), (6, "W5 w6\tw7 w8 w9 w10 w11\nw12")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (5, 6, 7):
        assert result(substring_dup.remove_repeats(docs, window)) == brute(rows, window)
    assert substring_dup.remove_repeats(docs.limit(0)).count() == 0
