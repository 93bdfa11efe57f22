import numpy as np
import pytest

from tidewater.llm import neighbours as N


def test_quantile():
    # Known values of the chi-square distribution.
    assert N.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert N.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_leaf_distances():
    rng = np.random.default_rng(2)
    points, q = rng.normal(size=(500, 4)), rng.normal(size=(20, 4))
    tree = N.split(points, 16)
    leaf = N.place(tree, points)
    gap = N.leaf_distances(tree, q, int(leaf.max()) + 1)
    for i in range(int(leaf.max()) + 1):
        true = ((q[:, None] - points[leaf == i][None]) ** 2).sum(-1).min(axis=1)
        assert (gap[:, i] <= true + 1e-9).all()


def recall(spark, v, k=20, **options):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    v = v.astype(np.float32).astype(np.float64)
    rows = N.nearest(df, df.where("vec_id % 20 = 0"), k, **options).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append(r)
    hit = 0
    for q, own in found.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, k + 1))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(r.vec_id != q and r.score == pytest.approx(v[q] @ v[r.vec_id], abs=1e-12) for r in own)
        s = v @ v[q]
        s[q] = -np.inf
        hit += len({r.vec_id for r in own} & set(np.lexsort((np.arange(len(s)), -s))[:k].tolist()))
    assert len(found) == -(-len(v) // 20)
    return hit / (k * len(found))


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 300)
    monkeypatch.setattr(N, "LEAF", 40)
    monkeypatch.setattr(N, "BLOCK", 30)
    monkeypatch.setattr(N, "PROBES", 200)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24)) * 2
    v = (centres[rng.integers(0, 12, 2000)] + rng.normal(size=(2000, 24))) * rng.uniform(0.5, 2, (2000, 1))
    v[300:900] = v[300]
    assert recall(spark, v) >= 0.95


def test_contrasted_vectors_verify_few_points(spark, monkeypatch):
    """Clusters far apart: a query's neighbours are in one, and the test stops before the others."""
    monkeypatch.setattr(N, "CELL", 100)
    monkeypatch.setattr(N, "LEAF", 20)
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 32))
    centres *= 20 / np.linalg.norm(centres, axis=1, keepdims=True)
    v = centres[rng.integers(0, 30, 2400)] + rng.normal(size=(2400, 32)) * 0.3
    stats = {}
    assert recall(spark, v, stats=stats) >= 0.9
    assert stats["verified"] < 1 / 3 and stats["rounds"] > 1


def test_given_vectors(spark, sf):
    v = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()], np.float32)
    assert recall(spark, v) >= 0.95


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (20, [0.0, 1.0], "x"), (1, None, "x"), (2, [0.0, 0.0], "x"), (3, [nan, 1.0], "x"), (4, [inf, 1.0], "x"), (5, [None, 1.0], "x"),
            (6, [1.0], "x"), (7, [], "x"), (None, [1.0, 1.0], "x"), (8, [1.0, 1.0], "x"), (9, [1.0, 1.0], "x"), (40, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in N.nearest(df, df.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8, 1.0), (0, 2, 9, 1.0), (0, 3, 40, 1.0), (20, 1, 8, 1.0), (20, 2, 9, 1.0), (20, 3, 40, 1.0), (40, 1, 8, 2.0), (40, 2, 9, 2.0), (40, 3, 0, 1.0)]
    assert N.nearest(df.limit(0), df).count() == 0 and N.nearest(df, df.limit(0)).count() == 0
