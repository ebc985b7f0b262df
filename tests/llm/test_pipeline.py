"""The pipeline's stages on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, comp string, text_key string, lang_pred string"
ITEM = " ".join(f"q{k}" for k in range(20))
LONG = " ".join(f"w{k}" for k in range(60_000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "k", "c", "t", "p") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_language_id_rejects_texts_without_letters(spark, sf):
    words = [(k, "the cat sat on the mat", "en") for k in range(20)] + [(k + 20, "der hund und die katze", "de") for k in range(20)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 !? 456", "en"), (None, "the mat", None), (103, "the cat", "en"), (103, "the cat", "en"), (104, LONG, None)]
    docs = table(spark, words + odd)
    got = cp.identify_language(spark, docs, sf)
    assert got.columns == docs.columns
    assert kept(got) == sorted([(i, t) for i, t, _ in words + odd if i not in (100, 101, 102)], key=str)
    assert cp.identify_language(spark, docs.limit(0), sf).count() == 0
    # nothing to learn from: no document has a language
    assert cp.identify_language(spark, table(spark, odd).withColumn("lang", cp.F.lit(None).cast("string")), sf).count() == 0


def test_near_duplicates_leave_one_row_of_each(spark, sf):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text, "en"), (5, text, "en"), (3, text + " more", "en"), (None, text, "en"), (None, "only without an id " * 3, "en"), (None, "only without an id " * 3, "en"), (7, "b c", "en"), (7, "a different text", "en"), (8, None, "en"), (9, "", "en"), (10, LONG, "en"), (11, LONG + " z", "en")]
    docs = table(spark, rows)
    got = cp.drop_near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    assert kept(got) == sorted([(3, text + " more"), (None, "only without an id " * 3), (7, "a different text"), (8, None), (9, ""), (10, LONG)], key=str)
    assert cp.drop_near_duplicates(spark, docs.limit(0), sf).count() == 0


def test_contaminated_documents_go(spark, sf):
    rows = [(1, None, "en"), (2, "", "en"), (3, ITEM.upper(), "en"), (3, ITEM.upper(), "en"), (None, f"x {ITEM} y", "en"), (4, ITEM + " x" * 500, "en"), (5, LONG + " " + ITEM, "en")]
    docs = table(spark, rows)
    got = cp.drop_contaminated(spark, docs, sf)
    assert got.columns == docs.columns
    assert [i for i, _ in kept(got)] == [1, 2, 4, 5]
    assert cp.drop_contaminated(spark, docs.limit(0), sf).count() == 0


def test_secrets_are_replaced_and_documents_stay(spark, sf):
    secret = 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'
    rows = [(1, None, "en"), (2, "", "en"), (3, f"a {secret} b", "en"), (3, f"a {secret} b", "en"), (None, "clean text", "en"), (4, LONG + " " + secret, "en")]
    got = cp.redact_secrets(spark, table(spark, rows), sf)
    clean = 'token = "<secret>"'
    assert kept(got) == sorted([(1, None), (2, ""), (3, f"a {clean} b"), (3, f"a {clean} b"), (None, "clean text"), (4, LONG + " " + clean)], key=str)
    assert {r.n_chars == len(r.text or "") for r in got.collect()} == {True}
    assert cp.redact_secrets(spark, table(spark, rows).limit(0), sf).count() == 0


def test_encoding_keeps_every_row(spark, sf):
    rows = [(1, None, "en"), (2, "", "en"), (3, "a b", "en"), (3, "a b", "en"), (None, "c", "en"), (4, LONG, "en")]
    got = cp.encode(spark, table(spark, rows), sf).collect()
    assert sorted((str(r.doc_id), r.n_tokens == len(r.ids), r.n_tokens > 0) for r in got) == sorted((str(i), True, bool(t)) for i, t, _ in rows)
    assert cp.encode(spark, table(spark, rows).limit(0), sf).count() == 0
