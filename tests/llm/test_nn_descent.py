import numpy as np

from weir.llm import nn_descent


def brute(rows, asked, k=5):
    rows = [(i, np.array(v, float)) for i, v in rows]
    m = np.array([v / np.linalg.norm(v) for _, v in rows])
    out = {}
    for p, (i, _) in enumerate(rows):
        if i in asked:
            s = m @ m[p]
            out[i] = sorted(((-round(float(s[j]), 12), rows[j][0]) for j in range(len(rows)) if j != p))[:k]
    return out


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows, {i for i, _ in rows if i % 50 == 0})
    got = {}
    for r in nn_descent.nearest(table, nn_descent.F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hit = sum(len({x for _, x, _ in got[q]} & {x for _, x in want[q]}) for q in want)
    assert hit / (5 * len(want)) >= 0.95


def test_equal_vectors_nulls_and_few_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 1.0, 0.0]), (None, [1.0, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nn_descent.nearest(table, nn_descent.F.lit(True)).collect())
    want = [(1, 1, 2), (1, 2, 3), (1, 3, 7), (2, 1, 1), (2, 2, 3), (2, 3, 7), (3, 1, 1), (3, 2, 2), (3, 3, 7), (7, 1, 1), (7, 2, 2), (7, 3, 3), (9, 1, 10), (10, 1, 9)]
    assert got == want
    assert nn_descent.nearest(table.limit(0), nn_descent.F.lit(True)).count() == 0


def test_recall_among_many_uniform_vectors(spark):
    """20,000 vectors without any structure; the beam has to be measured, as a fixed one would do at one size only."""
    import pyarrow as pa

    v = np.random.default_rng(3).standard_normal((20_000, 64)).astype(np.float32)
    rows = pa.table({"vec_id": np.arange(len(v)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 64).cast(pa.list_(pa.float32())), "node": ["x"] * len(v)})
    table = spark.createDataFrame(rows).repartition(4)
    asked = np.arange(0, len(v), 100)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = unit[asked] @ unit.T
    sims[np.arange(len(asked)), asked] = -9
    want = {int(q): set(np.argpartition(-s, 5)[:5].tolist()) for q, s in zip(asked, sims, strict=True)}
    got = {}
    for r in nn_descent.nearest(table, nn_descent.F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want) and {len(x) for x in got.values()} == {5}
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * 5 * len(want)


def test_dimensions_and_a_common_vector(spark):
    """Vectors of three dimensions, each searched by itself; one vector is that of a third of the rows."""
    rng = np.random.default_rng(4)
    groups = {d: [(d * 1000 + k, v.tolist()) for k, v in enumerate(rng.standard_normal((150, d)))] for d in (2, 8, 33)}
    groups[8] += [(20_000 + k, groups[8][0][1]) for k in range(200)]
    rows = [r for g in groups.values() for r in g]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nn_descent.nearest(table, nn_descent.F.col("vec_id") % 5 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = {q: x for g in groups.values() for q, x in brute(g, {i for i, _ in g if i % 5 == 0}).items()}
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {q: [v for _, v in x] for q, x in want.items()}


def test_queries_that_walks_do_not_answer_are_compared_with_all(spark, monkeypatch):
    """A graph without rounds and a beam of two find little; nothing poor is returned."""
    for name, value in (("BEAM", 2), ("WIDEST", 2), ("CODES", 1), ("CHUNK", 8), ("DEGREE", 2), ("BLOCK", 16)):
        monkeypatch.setattr(nn_descent, name, value)
    v = np.random.default_rng(6).standard_normal((600, 24))
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in nn_descent.nearest(table, nn_descent.F.col("vec_id") % 10 == 0, most_rounds=0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = brute(list(enumerate(v)), set(range(0, 600, 10)))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}


def test_walks_keep_what_they_can_visit_and_are_not_widened_beyond_comparing(spark, monkeypatch):
    """A walk is one row of 2 * beam nodes at most, visits read stored neighbours, and where a wider beam costs more than comparing all, all are compared."""
    beams, search, compared = [], nn_descent.search, []
    inner = nn_descent.compared

    def walked(index, queries, beam, *before):
        out = search(index, queries, beam, *before)
        beams.append((beam, out.df.count(), queries.select("q").distinct().count(), out.df.agg(nn_descent.F.max(nn_descent.F.octet_length("ids"))).first()[0]))
        near = index.wide()
        plan = near.join(nn_descent.F.broadcast(near.select("node").limit(1)), "node").groupBy("node").count()._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan
        return out

    monkeypatch.setattr(nn_descent, "search", walked)
    monkeypatch.setattr(nn_descent, "compared", lambda *a: (compared.append(1), inner(*a))[1])
    for name, value in (("BEAM", 8), ("CODES", 1), ("CHUNK", 8), ("DEGREE", 4)):
        monkeypatch.setattr(nn_descent, name, value)
    v = np.random.default_rng(8).standard_normal((6_000, 48))
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nn_descent.nearest(table, nn_descent.F.col("vec_id") % 50 == 0, most_rounds=0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert [b[0] for b in beams] == [8] and compared == [1]
    assert all(rows == asked == 120 and most <= 2 * beam * 8 for beam, rows, asked, most in beams)
    want = brute(rows, set(range(0, 6_000, 50)))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
