import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwarden.llm import topk


def brute(ids, q, k):
    out = {}
    for i, v in zip(ids, q):
        if i is not None and i % 20 == 0:
            scores = [(-int(v @ w), j) for j, w in zip(ids, q) if j != i]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("kind", ["random", "clusters", "one", "equal"])
def test_top_k_is_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    n = 700
    v = {"random": rng.standard_normal((n, 8)), "clusters": rng.standard_normal((7, 8))[rng.integers(0, 7, n)] + 0.01 * rng.standard_normal((n, 8)), "one": np.concatenate([np.ones((500, 8)), rng.standard_normal((200, 8))]), "equal": np.ones((n, 8))}[kind]
    df = spark.createDataFrame([(i, [float(y) for y in x], 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=5, block_rows=100).toPandas()
    q = np.floor(64 * np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], np.float64)).astype(int)
    want = brute(list(range(n)), q, 5)
    assert {i: sorted(map(tuple, g[["rank", "vec_id", "score"]].to_numpy().tolist())) for i, g in got.groupby("query_id")} == want


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.25]), (6, [1.0, 2.0, 3.0]), (7, []), (5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=20).collect()))
    assert [x[:3] for x in got] == [(0, 1, 5), (0, 2, 5), (0, 3, 20), (20, 1, 0), (20, 2, 5), (20, 3, 5)]
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_query_ids_that_repeat(spark, tmp_path):
    """Each row that asks has its own k rows, whether rows of one id are equal or not; the SQL says the same."""
    import duckdb

    from tickwarden.llm import oracle

    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(4)) for i in range(1, 59)] + [(0, rng.standard_normal(4)), (0, rng.standard_normal(4)), (20, np.ones(4)), (20, np.ones(4))]
    df = spark.createDataFrame([(i, [float(x) for x in v], i, 0.5) for i, v in rows], "vec_id long, embedding array<float>, row long, least double")
    got = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=20, block_rows=16).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = [(i, np.floor(64 * np.float32(v).astype(np.float64)).astype(int)) for i, v in rows]
    want = {}
    for i, v in q:
        if i % 20 == 0:
            scores = sorted((-int(v @ w), j) for j, w in q if j != i)[:20]
            want.setdefault(i, []).extend((n + 1, j, -s) for n, (s, j) in enumerate(scores))
    assert {i: sorted(x) for i, x in by.items()} == {i: sorted(x) for i, x in want.items()} and len(by[0]) == 40 and len(by[20]) == 60
    df.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert sorted(con.sql(oracle.TOP_K).fetchall()) == sorted(tuple(r) for r in got)


@pytest.mark.parametrize("kind", ["gauss", "clusters", "copies"])
def test_tree_covers_and_separates(kind):
    rng = np.random.default_rng(1)
    p = {"gauss": rng.standard_normal((2000, 2)), "clusters": np.repeat(rng.standard_normal((9, 40)), 200, axis=0) + 1e-3 * rng.standard_normal((1800, 40)), "copies": np.ones((300, 3))}[kind]
    tree = topk.CoverTree(p)
    assert sorted(tree.order) == list(range(len(p)))
    for n, (s, e, centre, radius) in enumerate(zip(tree.start, tree.end, tree.centre, tree.radius)):
        assert np.sqrt(((p[tree.order[s:e]] - centre) ** 2).sum(axis=1)).max() <= radius + 1e-9
        below = tree.children[n]
        assert not below or sum(tree.end[c] - tree.start[c] for c in below) == e - s
        for c in below:
            assert tree.radius[c] <= radius / topk.BASE + 1e-9
            assert all(np.sqrt(((tree.centre[c] - tree.centre[d]) ** 2).sum()) > radius / topk.BASE - 1e-9 for d in below if d != c)
    assert kind == "copies" or len(tree.start) > 1


def search(rows, k=20, block_rows=1024):
    def of(spark):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=k, block_rows=block_rows).toPandas()
        q = [[math.floor(64 * x) for x in v] for _, v in rows]
        want = {}
        for i, (a, v) in enumerate(zip([r[0] for r in rows], q)):
            if a % 20 == 0:
                every = sorted((-sum(x * y for x, y in zip(v, w)), b) for (b, _), w in zip(rows, q) if b != a)[:k]
                want[a] = [(n + 1, b, -s) for n, (s, b) in enumerate(every)]
        assert {i: sorted(map(tuple, g[["rank", "vec_id", "score"]].to_numpy().tolist())) for i, g in got.groupby("query_id")} == want

    return of


def test_negative_scores_and_ties_lose_no_rows(spark):
    search([(0, [1.0, 0.0])] + [(i, [-100.0, 200.0 if i % 2 else -200.0]) for i in range(1, 79)])(spark)
    search([(i, [-1.0 if i else 1.0, float(i % 2)]) for i in range(300)], block_rows=50)(spark)
    search([(i, [0.5, 0.5] if i % 3 else [-0.5, -0.5]) for i in range(200)], k=90, block_rows=40)(spark)


def test_scores_beyond_doubles_are_exact(spark):
    search([(i, [2.0**24 + i, 2.0**22 - 3 * i, 1.0]) for i in range(45)], k=5)(spark)


def test_floor_with_all_scores_equal_to_it():
    q, p = np.array([[64.0, 0.0]]), np.array([[-6400.0, 12800.0 * (-1) ** i] for i in range(78)])
    row, col, score = topk.dual_tree_top_k(q, np.array([1000]), p, np.arange(78), 20, np.array([-1e9]))
    assert sorted(col) == list(range(20)) and set(score) == {-409600}
