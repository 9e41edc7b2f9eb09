"""Exact top-k by cover trees, and neighbours along Hilbert curves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.llm import covertree, curves

SCHEMA = "vec_id long, embedding array<float>, label int"


def odd(rows):
    """Vectors that take no part."""
    return [*rows, (10_001, None, 0), (10_002, [1.0, None], 0), (10_003, [float("nan")] * 8, 0), (10_000, [float("inf")] * 8, 0)]


def vectors(n, seed=0, repeated=0):
    x = np.random.default_rng(seed).standard_normal((n, 8)).astype(np.float32)
    x[:repeated] = x[0]
    return [(i, v.tolist(), 0) for i, v in enumerate(x)]


@pytest.mark.parametrize(("n", "repeated"), [(400, 0), (400, 130), (3, 0)])
def test_top_k(spark, n, repeated):
    rows = vectors(n, repeated=repeated)
    df = spark.createDataFrame(odd(rows), SCHEMA).withColumn("v", F.lit(1)).withColumn("own", F.lit(2)).withColumn("id", F.lit(3))
    x = covertree.scaled_integers(df)
    got = covertree.top_k(x.where("id % 50 = 0"), x, k=5, query_block=3, data_block=90).collect()
    v = np.floor(np.array([r[1] for r in rows]) * 256)
    want = set()
    for q in range(0, n, 50):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(n), -s)) if i != q][:5]
        want |= {(q, k + 1, i, s[i]) for k, i in enumerate(order)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_counts_repeated_rows_as_its_sql_does(spark, tmp_path):
    import duckdb

    rows = vectors(200)
    rows += [rows[7]] * 6 + [rows[50]] * 2 + [(8, rows[9][1], 0), (100, rows[9][1], 0)]  # data, a query, and other vectors of ids
    embeddings = spark.createDataFrame(rows, SCHEMA)
    embeddings.write.parquet(str(tmp_path / "embeddings.parquet"))
    x = covertree.scaled_integers(embeddings)
    got = covertree.top_k(x.where("id % 50 = 0"), x, k=5).select("query_id", "rank", "vec_id", F.col("score").cast("long")).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(covertree.ORACLE).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 25


def test_dual_tree_prunes_and_covers():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 6)) * 20_000
    x = np.rint(centres[rng.integers(0, 30, 30_000)] + rng.standard_normal((30_000, 6)) * 100)
    tree = covertree.CoverTree(x, 48)
    for node, (a, b) in enumerate(tree.run):
        far, angle, length = covertree.away(tree.points[a:b], tree.nodes.centre[node])
        assert far.max() <= tree.nodes.radius[node] and angle.max() <= tree.nodes.angle[node]
        assert tree.nodes.shortest[node] <= length.min() and length.max() <= tree.nodes.longest[node]
        kids = tree.children[node]
        assert not kids or sorted(tree.run[k] for k in kids)[0][0] == a and sum(tree.run[k][1] - tree.run[k][0] for k in kids) == b - a
    best, scored = covertree.dual_tree(x[:400], np.arange(400), x, np.arange(30_000), 5)
    s = x[:400] @ x.T
    s[np.arange(400), np.arange(400)] = -np.inf
    assert (best.score == -np.sort(-s, axis=1)[:, :5]).all() and scored < 0.4 * s.size
    floor = (best.score[:, -1]).copy()
    again, fewer = covertree.dual_tree(x[:400], np.arange(400), x, np.arange(30_000), 5, floor)
    assert (again.score == best.score).all() and (again.id == best.id).all() and fewer <= scored
    limit = covertree.bounds(tree.nodes, tree.nodes)
    for m, n in rng.integers(0, len(tree.run), (300, 2)):
        assert (tree.points[slice(*tree.run[m])] @ tree.points[slice(*tree.run[n])].T).max() <= limit[m, n]


def brute_top(rows, k=5):
    """rows: (id, vector). In whole numbers of Python."""
    v = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, end = set(), 2**63 - 1
    for q, a in v:
        if q % 50 == 0:
            scores = [(-max(-end + 1, min(end, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in v if i != q and len(a) == len(b)]
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("data_block", [90, 1 << 16])
def test_top_k_of_odd_rows(spark, data_block):
    """Rows without an id, empty vectors, other lengths, and numbers whose products need more than a double or a long."""
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((230, 8)))]
    rows += [(None, rows[3][1]), (None, None), (300, []), (301, []), (350, [1.0, 2.0]), (351, [3.0]), (352, [0.5, 1.0])]
    rows += [(400 + i, (v * 2.0**29).tolist()) for i, v in enumerate(rng.standard_normal((9, 8)))]
    rows += [(450, [1e30] * 8), (451, [-1e30, 1e30] * 4), (452, [1e300] * 8), (500, [2.0**46 + 1] * 8), (501, [3.0**29, 1.0] * 4), (502, [3.0**29, 1.0] * 4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    x = covertree.scaled_integers(df)
    got = covertree.top_k(x.where("id % 50 = 0"), x, k=5, query_block=3, data_block=data_block).collect()
    assert {tuple(r) for r in got} == brute_top(rows) and len(got) == len(brute_top(rows))


@pytest.mark.parametrize("times", [1, 2000])
def test_top_k_of_clusters_and_a_common_vector(spark, times):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 5)) * 30
    rows = [(i, (centres[i % 12] + rng.standard_normal(5)).tolist()) for i in range(4000)]
    rows += [rows[50]] * times + [(5000 + i, rows[7][1]) for i in range(times)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    x = covertree.scaled_integers(df)
    got = covertree.top_k(x.where("id % 50 = 0"), x, k=5, data_block=700).collect()
    ids, v = np.array([r[0] for r in rows]), np.floor(np.array([r[1] for r in rows]) * 256)
    for q in {r.query_id for r in got} | set(range(0, 4000, 50)):
        s = v[ids == q][0] @ v.T
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:5]
        want = [(ids[j], s[j]) for j in order]  # an equal query is answered once
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_hilbert_steps_are_neighbours():
    for bits, dims in ((4, 2), (3, 3), (2, 4)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = curves.hilbert(grid, bits)
        path = grid[np.argsort(key)]
        assert sorted(key) == list(range(len(grid))) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize(("n", "repeated"), [(1200, 0), (1200, 400)])
def test_neighbours(spark, n, repeated):
    rows = vectors(n, 5, repeated)
    df = spark.createDataFrame([*odd(rows), (20_000, [0.0] * 8, 0)], SCHEMA).withColumn("block", F.lit(1)).withColumn("key", F.lit(2))
    x = curves.vectors(df)
    got = curves.search(x, x.where("id % 20 = 0"), k=20).collect()
    v = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    hits = 0
    for q in range(0, n, 20):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 21))
        s = v @ v[q]
        assert all(np.isclose(score, s[i], rtol=1e-12, atol=1e-12) and i != q for _, i, score in own)
        assert [(r[2], -r[1]) for r in own] == sorted([(r[2], -r[1]) for r in own], reverse=True)
        s[q] = -np.inf
        hits += sum(score >= np.sort(s)[-20] - 1e-9 for _, _, score in own)
    assert hits / (n / 20 * 20) >= 0.9


def test_neighbours_of_repeated_rows(spark):
    rows = vectors(120, 5)
    near = (-np.array([r[1] for r in rows]) @ np.array(rows[0][1])).argsort()
    near = [int(i) for i in near if i][:3]
    more = [rows[near[0]]] * 30 + [(near[1], [x * (1 + n / 100) for x in rows[near[1]][1]], 0) for n in range(1, 25)] + [rows[0]] * 3
    x = curves.vectors(spark.createDataFrame(rows + more, SCHEMA))
    got = sorted((r.rank, r.vec_id, r.score) for r in curves.search(x, x.where("id = 0"), k=20, window=1.0).collect())
    q, best = np.array(rows[0][1], np.float32).astype(float), {}
    for i, v, _ in rows + more:
        best[i] = max(best.get(i, -np.inf), float(np.array(v, np.float32).astype(float) @ q))
    want = sorted((i for i in best if i), key=lambda i: (-best[i], i))[:20]
    assert [r[1] for r in got] == want and np.allclose([r[2] for r in got], [best[i] for i in want])


def test_neighbours_without_an_id(spark):
    """Rows without an id, and vectors that are empty, take no part."""
    rows = vectors(40, 6)
    x = curves.vectors(spark.createDataFrame(rows + [(None, rows[0][1], 0), (None, None, 0), (60, [], 0), (80, [0.0], 0)], SCHEMA))
    got = curves.search(x, x.where("id % 20 = 0"), k=20, window=1.0).collect()
    assert {r.query_id for r in got} == {0, 20} and all(r.vec_id is not None and r.vec_id < 40 for r in got)
    bare = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    assert [(r.query_id, r.vec_id) for r in curves.search(bare, bare).collect()] and {r.query_id for r in curves.search(bare, bare).collect()} == {1, 2}


def test_few_or_no_vectors(spark):
    few = curves.vectors(spark.createDataFrame(vectors(3), SCHEMA))
    assert curves.search(few, few.where("id = 0"), k=20).count() == 2
    assert curves.search(few.limit(0), few.limit(0)).count() == 0
    none = covertree.scaled_integers(spark.createDataFrame([], SCHEMA))
    assert covertree.top_k(none, none).count() == 0
