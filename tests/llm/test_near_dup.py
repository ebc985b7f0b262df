import re
from itertools import combinations

import pytest

from weir.llm import near_dup


def brute(rows):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        if not words:
            return frozenset()
        return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, set()).add(k)
    seen = set()
    for ks in by_shingle.values():
        seen.update(combinations(sorted(ks), 2))
    for a, b in seen:
        (i, s), (j, t) = sets[a], sets[b]
        n = len(s & t)
        if 100 * n >= 75 * (len(s) + len(t) - n):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("small_bucket", [40, 2])
def test_matches_brute_force(spark, monkeypatch, small_bucket):
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", small_bucket)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("component_id", near_dup.F.lit("x"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs).collect()}
    assert got == want


def test_templates_that_share_buckets_but_are_not_similar(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 3)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base + [f"x{k // 3}_{i}" for i in range(22)] + [f"y{k}"])) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_nulls_empty_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  B"), (5, text), (5, text), (None, text), (6, "other " * 20), (6, text), (7, "other " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 26, 5, True), (5, 26, 5, True), (6, 1, 5, False), (6, 26, 5, False), (7, 1, 5, False), (None, 26, None, True)]
    assert got == sorted(want, key=str)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_crowds_in_blocks_of_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 2_000)
    test_templates_that_share_buckets_but_are_not_similar(spark, monkeypatch)


def test_only_plain_scans_are_read_where_they_lie(spark, tmp_path):
    from weir.llm.tables import fixed

    spark.range(20).write.parquet(str(tmp_path / "t"))
    plain = spark.read.parquet(str(tmp_path / "t")).where("id > 3").selectExpr("id", "id % 7 AS k")
    assert fixed(plain, "t") is plain
    dealt = fixed(plain.repartition(3, near_dup.F.rand()), "t").withColumn("n", near_dup.F.monotonically_increasing_id())
    assert {(r.id, r.n) for r in dealt.collect()} == {(r.id, r.n) for r in dealt.collect()} and "Exchange" not in dealt._jdf.queryExecution().toString()
