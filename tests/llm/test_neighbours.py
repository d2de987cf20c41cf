import numpy as np
import pytest

from pagemill.llm import neighbours


def brute(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = neighbours.distances(u, u)
    out = {}
    for i, row in enumerate(d):
        order = [j for j in np.lexsort((ids, row)) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        out.setdefault(r.vec_id, []).append(r.neighbour_id)
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 12)) + np.repeat(rng.standard_normal((9, 12)) * 3, 100, 0)
    x[500:520] = x[500]  # ties
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()


def test_factor_one_is_exact(vectors):
    x, df = vectors
    assert found(neighbours.nearest(df, 5, 1.0, 120)) == brute(x, np.arange(len(x)), 5)


def test_production_factor_recalls(vectors):
    x, df = vectors
    want, got = brute(x, np.arange(len(x)), 10), found(neighbours.nearest(df, 10, neighbours.FACTOR, 120))
    assert sum(len(set(want[i]) & set(got[i])) for i in want) / (10 * len(want)) >= 0.9


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [1.0, 1.0], None), (3, [1.0, 1.0], "again"), (4, None, ""), (5, [0.0, 0.0], ""), (6, [1.0], ""), (7, [float("nan"), 1.0], ""), (None, [1.0, 0.0], ""), (8, [None, 1.0], ""), (9, [], "")]
    got = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string"), 5))
    assert got == {1: [3, 2], 2: [3, 1], 3: [1, 2]}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_many_equal_vectors(spark, limit):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 4))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(x, np.arange(len(x)), 6)
    assert found(neighbours.nearest(df, 6, 1.0, 30, send_limit=limit)) == want
    assert found(neighbours.nearest(df, 6, 1.0, 30, every=20)) == {i: v for i, v in want.items() if i % 20 == 0}


def test_empty(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
