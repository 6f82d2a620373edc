import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann as A


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v))]
    out = []
    for q, v in ok:
        if q % 3 == 0:
            near = sorted((-float(np.dot(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def test_few_rows_are_whole(spark):
    """With fewer candidates than k everything is found; copies, ties, odd vectors and odd ids included."""
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(25)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 1.0]) for i in range(30, 34)] + [rows[3], rows[6]]
    rows += [(40, None), (41, []), (42, [0.0] * 5), (43, [float("nan")] * 5), (45, [None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 5), (48, [float("inf")] * 5), (51, [1.0, 2.0]), (54, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    for chunk in (4096, 4):
        got = sorted(tuple(r) for r in A.search(df, F.col("vec_id") % 3 == 0, k=40, chunk=chunk).collect())
        want = brute(rows, 40)
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert np.allclose([r[3] for r in got], [r[3] for r in want])


def test_recall_and_hot_vector(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:2000] = x[1000]
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, v array<double>").repartition(4)
    got = {}
    for r in A.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        want = sorted((round(-float(v), 12), int(i)) for i, v in enumerate(s) if i != q)[:20]
        assert sorted(got[q]) == list(range(1, 21))
        hits += len({i for _, i in want} & {i for i, _ in got[q].values()})
    assert hits / (150 * 20) >= 0.9


def test_empty(spark):
    assert A.search(spark.createDataFrame([], "vec_id long, v array<float>"), F.col("vec_id") > 0).count() == 0


@pytest.mark.parametrize("kind", ["one outlier", "lognormal 0.5", "lognormal 1", "hot outlier"])
def test_unequal_norms_with_production_parameters(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "one outlier":
        x[77] *= 5
    elif kind == "hot outlier":
        x[1900:] = x[77] * 5
    else:
        x *= rng.lognormal(0, float(kind.split()[1]), (2000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(4)
    got = {}
    for r in A.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 2000, 20):
        score = x @ x[q]
        want = sorted((-round(float(v), 12), i) for i, v in enumerate(score) if i != q)[:20]
        hits += len({i for _, i in want} & got[q])
    assert hits / (100 * 20) >= 0.9


@pytest.mark.parametrize("kind", ["float", "double"])
def test_ties_go_to_smaller_ids(spark, kind):
    """4,096 sign vectors: whole shells of equal scores, of which the cut takes the smallest ids; all buckets are probed."""
    x = np.array([[1.0 if i >> b & 1 else -1.0 for b in range(12)] for i in range(4096)])
    ids = np.random.default_rng(5).permutation(4096)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], f"vec_id long, v array<{kind}>").repartition(4)
    got = {}
    for r in A.search(df, F.col("vec_id") % 100 == 0, k=20, tables=1, probes=1 << 30).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for i, v in zip(ids, x):
        if i % 100 == 0:
            want = sorted((-s, int(j)) for j, s in zip(ids, x @ v) if j != i)[:20]
            assert [got[i][k] for k in range(1, 21)] == [(j, -s) for s, j in want]


def test_joint_axes(spark):
    """Buckets of about 4 rows: two rotations in a table."""
    assert A.levels(64, 50_000, 256) == [64] and A.levels(64, 10**6, 256) == [64, 8] and A.levels(64, 10**9, 256) == [64, 64, 64] and A.levels(1, 10**9, 1) == [1]
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(300, 16))
    x = centres[rng.integers(0, 300, 6000)] + 0.4 * rng.normal(size=(6000, 16))
    assert A.levels(16, 6000, 4) == [16, 16]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(4)
    got = {}
    for r in A.search(df, F.col("vec_id") % 50 == 0, k=10, per_bucket=4).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(set(np.argsort(-(x @ x[q]) + 9.0 * (np.arange(6000) == q))[:10].tolist()) & got[q]) for q in range(0, 6000, 50))
    assert hits / 1200 >= 0.9
    probed = A.axes(x[:5], 3, 200, [16, 16])
    r = [A.rotated(x[:5], 3 + 1000 * k) for k in (0, 1)]
    far = [(np.abs(y).max(axis=1)[:, None] - np.stack([-y, y], axis=2).reshape(5, -1)) ** 2 for y in r]
    total = (far[0][:, :, None] + far[1][:, None, :]).reshape(5, -1)
    assert np.allclose(np.take_along_axis(total, probed, 1), np.sort(total, axis=1)[:, :200])


def test_very_long_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 5000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = sorted(tuple(r)[:3] for r in A.search(df, F.col("vec_id") % 3 == 0, k=5).collect())
    assert [g for g in got] == [g[:3] for g in brute([(i, v.tolist()) for i, v in enumerate(x)], 5)]
