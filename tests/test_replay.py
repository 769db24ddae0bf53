"""Replays against a fit of its own for each case."""

import random

import numpy as np

from swissline.operators import replay

X = ["a", "b", "c"]


def fit(rows, ridge=1e-6):
    """weights and bias of a linear discriminant of (label, features)."""
    y, x = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], float).reshape(len(rows), 3)
    if not len(rows) or y.min() == y.max():
        return np.zeros(3), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m1, m0 = x[y == 1].mean(0), x[y == 0].mean(0)
    away = x - np.where(y[:, None] == 1, m1, m0)
    w = np.linalg.solve(away.T @ away / len(y) + ridge * np.eye(3), m1 - m0)
    return w, np.log(y.sum() / (len(y) - y.sum())) - 0.5 * (m1 + m0) @ w


def test_each_case_has_the_model_of_its_own_past(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(12) * 3, rnd.randrange(2), rnd.gauss(0, 1), rnd.gauss(1, 2), rnd.random()) for i in range(300)]
    rows += [(900, 0, None, 1.0, 1.0, 1.0), (901, 3, 1, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "match_id long, day long, label int, a double, b double, c double").repartition(4)
    cases = spark.createDataFrame([(k, day, rnd.randrange(2), 0.3, -1.0, 0.5) for k, day in enumerate((0, 1, 4, 10, 22, 33, 90, 10))], "case_id long, day long, label int, a double, b double, c double")
    for most in (None, 9):
        got = {r.case_id: r for r in replay.replayed(df, cases, X, most).collect()}
        assert len(got) == 8
        for r in got.values():
            past = [q[2:] for q in rows if None not in q and q[1] < r.day and (most is None or q[1] >= r.day - most)]
            w, bias = fit(past)
            assert r.trained == len(past) and abs(r.p - 1 / (1 + np.exp(-(w @ (0.3, -1.0, 0.5) + bias)))) < 1e-9, r


def test_later_rows_change_no_earlier_case(spark):
    rows = [(d, d % 2, float(d % 5), float(d % 3), 1.0 / (d + 1)) for d in range(40)]
    df = spark.createDataFrame(rows, "day long, label int, a double, b double, c double")
    cases = spark.createDataFrame([(1, 20, 1, 0.1, 0.2, 0.3)], "case_id long, day long, label int, a double, b double, c double")
    p = [replay.replayed(df.filter(f"day < {k}"), cases, X).first().p for k in (20, 40)]
    assert p[0] == p[1]


def test_reports(spark):
    scored = spark.createDataFrame([(1, 5, 0.9, 1), (1, 5, 0.8, 0), (2, 7, 0.4, 1), (2, 7, 0.6, 0), (2, 7, 0.2, 0)], "case_id long, trained long, p double, label int")
    cases = replay.case_reports(scored)
    assert {r.case_id: (r.picks, r.hits, r.passed) for r in cases.collect()} == {1: (2, 1, 1), 2: (3, 1, 0)}
    assert tuple(replay.suite_report(cases).first()) == (2, 1, 0.5, 1)
    assert tuple(replay.suite_report(cases.limit(0)).first()) == (0, 0, 0.0, 0)
