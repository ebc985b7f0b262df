"""Vector codes against plain Python integers, and the bounds of the VA-file search."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from weir.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int"


def plain(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label, digest) of rows (vec_id, vector, label), which have one dimension."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(good[0][1])
    spans = [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]
    books = [[v[lo:hi] for _, v, _ in good[:entries]] for lo, hi in spans]

    def near(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (lo, hi) in enumerate(spans):
            own = {}
            for _, v, _ in good:
                own.setdefault(near(books[p], v[lo:hi])[1], []).append(v[lo:hi])
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, lab in good:
        found = [near(books[p], v[lo:hi]) for p, (lo, hi) in enumerate(spans)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab, name))
    return out


def with_labels(told):
    total = {}
    for r in told:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((r[0], r[1], r[2], total[r[3]], r[4]) for r in told), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", 1) for i, v, lab in rows], SCHEMA)


def test_matches_plain_version_and_sql(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = with_labels(plain([(r.vec_id, r.embedding, r.label) for r in vectors.collect()]))
    assert got(vc.compress(vectors)) == want
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    assert sorted(con.execute(vc.OP11_SQL).fetchall(), key=str) == want


@pytest.mark.parametrize("bound", [48_000_000, 0])
def test_nulls_ties_repeated_rows_and_clashing_columns(spark, monkeypatch, bound):
    monkeypatch.setattr(vc, "small", lambda df: vc.F.broadcast(df) if bound else df)
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.integers(-3, 3, 32) / 4], int(k % 3) if k % 7 else None) for k in range(150)]
    odd = [(3, rows[3][1], 0), (3, rows[3][1], 0), (None, rows[9][1], 1), (151, None, 1), (152, [1.0] * 31 + [None], 1), (153, [1.0] * 31 + [math.nan], 2), (154, [math.inf] * 32, None), (155, [400_000.0, -400_000.0] * 16, 2), (5, rows[8][1], 1)]
    assert got(vc.compress(table(spark, rows + odd))) == with_labels(plain(rows + odd))
    assert vc.compress(table(spark, rows).limit(0)).count() == 0
    assert vc.compress(table(spark, rows).limit(0)).columns == vc.compress(table(spark, rows)).columns


def test_dimensions_by_themselves(spark):
    rng = np.random.default_rng(4)
    groups = [[(int(k) * 4 + g, [float(x) for x in rng.normal(size=dim)], 1) for k in range(80)] for g, dim in enumerate((5, 16, 33))]
    want = with_labels([r for g in groups for r in plain(g)] + [(999, "00" * 16, 0, 1, hashlib.sha256(b"").hexdigest())])
    assert got(vc.compress(table(spark, [r for g in groups for r in g] + [(999, [], 1)]))) == want


def test_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="has no code"):
        vc.compress(table(spark, [(1, [6e5] * 16, 1)])).collect()


def test_bounds_leave_the_nearest_and_spare_most_entries():
    rng = np.random.default_rng(5)
    book = vc.Cells(rng.integers(-60, 60, (64, 4)))
    parts = rng.integers(-70, 70, (3000, 4))
    whole = ((parts[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
    entry, distance = book.nearest(parts)
    assert (entry == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    row, _ = book.candidates(parts)
    assert len(row) < 8 * len(parts)
