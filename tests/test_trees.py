"""Trees against plain ones grown row by row."""

import math
import random

import numpy as np
import pytest

from swissline.operators import trees

X = ["a", "b", "c"]


def plain_thresholds(values):
    u = sorted(set(values))
    mids = [(x + y) / 2 for x, y in zip(u, u[1:])]
    return mids if len(mids) <= 16 else sorted({mids[round(i * (len(mids) - 1) / 15)] for i in range(16)})


def grow(x, y, w, n, cuts, depth, least, need):
    """A tree as nested tuples, by trying every threshold on every row; n: how often a row counts, w: its weight in all."""
    value = (w @ y) / w.sum() if w.sum() > 0 else 0.0
    if depth == 0 or n.sum() < need:
        return value
    error = lambda m: (w[m] * (y[m] - (w[m] @ y[m]) / w[m].sum()) ** 2).sum()
    best, at, whole = 1e-9, None, error(np.ones(len(y), bool))
    for f in range(x.shape[1]):
        for t in cuts[f]:
            left = x[:, f] <= t
            if n[left].sum() < least or n[~left].sum() < least:
                continue
            gain = whole - error(left) - error(~left)
            if gain > best + 1e-9:
                best, at = gain, (f, t, left)
    if at is None:
        return value
    f, t, left = at
    return f, t, grow(x[left], y[left], w[left], n[left], cuts, depth - 1, least, need), grow(x[~left], y[~left], w[~left], n[~left], cuts, depth - 1, least, need)


def value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(400):
        a, b, c = rnd.random(), rnd.randrange(5), rnd.gauss(0, 1)
        rows.append((i, int(rnd.random() < 0.2 + 0.6 * (a > 0.5) * (b > 1)), a, float(b), c))
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, c double").repartition(5)
    keys = {r[0]: r[1] for r in df.selectExpr("id", "xxhash64(id)").collect()}
    return df, np.array([r[2:] for r in rows]), np.array([r[1] for r in rows], float), np.array([keys[r[0]] for r in rows]), {tuple(r[2:]): r[0] for r in rows}


def test_thresholds_are_at_most_sixteen_midpoints(spark, data):
    df, x, *_ = data
    assert all(np.allclose(got, plain_thresholds(x[:, i]), atol=0) for i, got in enumerate(trees.cuts_of(df, X)))
    odd = spark.createDataFrame([(1.0, None), (1.0, float("nan")), (2.0, 5.0)], "a double, b double")
    assert trees.cuts_of(odd, ["a", "b"]) == [[1.5], []] and trees.cuts_of(odd.limit(0), ["a", "b"]) == [[], []]


def test_forest_is_that_of_plain_trees(data):
    df, x, y, key, ids = data
    model = trees.fit_forest(df, X, "id", trees=4, depth=4)
    cuts = [plain_thresholds(x[:, i]) for i in range(3)]
    grown = []
    for t in range(4):
        n = trees.bagged(key, 13, t)
        m = n > 0
        grown.append(grow(x[m], y[m], n[m].astype(float), n[m], cuts, 4, 3, 6))
    got = {r.id: r.p for r in trees.with_probability(df, model).collect()}
    for row in x:
        want = np.clip(np.mean([value(t, row) for t in grown]), 1e-6, 1 - 1e-6)
        assert abs(got[ids[tuple(row)]] - want) < 1e-9
    assert trees.with_probability(df, model).columns == [*df.columns, "p"]


def test_boosting_is_that_of_plain_trees(data):
    df, x, y, key, ids = data
    model = trees.fit_boosting(df, X, "id", rounds=3, depth=2, rate=0.3)
    cuts = [plain_thresholds(x[:, i]) for i in range(3)]
    score = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for r in range(3):
        m = trees.sampled(0.8)(key, 13, r) > 0
        left = y - 1 / (1 + np.exp(-score))
        tree = grow(x[m], left[m], np.ones(m.sum()), np.ones(m.sum(), int), cuts, 2, 1, 2)
        score += 0.3 * np.array([value(tree, row) for row in x])
    got = {r.id: r.p for r in trees.with_probability(df, model).collect()}
    assert all(abs(got[ids[tuple(row)]] - 1 / (1 + math.exp(-s))) < 1e-9 for row, s in zip(x, score))


def test_draws_have_mean_one():
    n = trees.bagged(np.arange(200_000), 13, 2)
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02


def test_one_class_and_no_rows(spark, data):
    df = data[0]
    one = trees.fit_forest(df.withColumn("label", df.label * 0 + 1), X, "id", trees=2, depth=2)
    assert {round(r.p, 5) for r in trees.with_probability(df, one).collect()} == {1.0}
    none = trees.fit_boosting(df.limit(0), X, "id", rounds=2, depth=2)
    assert {r.p for r in trees.with_probability(df, none).collect()} == {0.5}


def test_batches_are_looked_at_together():
    import pyarrow as pa

    rows = [pa.RecordBatch.from_arrays([pa.array([[i % 3, i % 2]], pa.list_(pa.int32())), pa.array([i]), pa.array([2.0]), pa.array([float(i % 2)])], ["bins", "key", "weight", "label"]) for i in range(50)]
    (bins, key, weight, y), = trees._joined(iter(rows), None, 2, lambda m, b, k: b.column("label").to_numpy())
    assert bins.tolist() == [[i % 3, i % 2] for i in range(50)] and key.tolist() == list(range(50)) and weight.tolist() == [2.0] * 50 and y.tolist() == [i % 2 for i in range(50)]
