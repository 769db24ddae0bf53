"""Tail probabilities against closed forms and numerical integration."""

import math

import numpy as np
from pyspark.sql import functions as F

from swissline.operators import evaluate


def by_integration(t, df):
    """2 * integral of the density from |t| on, in u = 1 / x (Gauss-Legendre)."""
    node, weight = np.polynomial.legendre.leggauss(400)
    top = 1 / abs(t)
    u = top * (node + 1) / 2
    log = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(1 / (u * u * df))
    return float(2 * (weight * top / 2 * np.exp(log) / (u * u)).sum())


def test_student_t_tail(spark):
    rows = [(t, float(df)) for df in (1, 2, 3, 4, 7, 30, 99, 1000, 9999, 10000) for t in (0.0, 0.05, -0.3, 1.0, 1.96, -2.5, 4.0, 9.0)] + [(1.0, 0.0), (None, 3.0)]
    got = spark.createDataFrame(rows, "t double, df double").withColumn("p", evaluate.student_t_tail(F.col("t"), F.col("df"))).collect()
    for r in got:
        if r.df == 0 or r.t is None:
            assert r.p is None
            continue
        t = abs(r.t)
        want = {1: 1 - 2 / math.pi * math.atan(t), 2: 1 - t / math.sqrt(2 + t * t)}.get(int(r.df)) if r.df < 3 else 1.0 if t == 0 else by_integration(t, r.df)
        assert abs(r.p - want) < 1e-9, (r, want)


def test_diebold_mariano_has_a_p_value(spark):
    rows = [(i, (i % 7) / 7, (i % 5) / 5, i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, p double, p2 double, label int")
    r = evaluate.diebold_mariano_test(df, "k").first()
    assert abs(r.p_value - by_integration(r.statistic, 99)) < 1e-9


def test_tails_are_computed_by_the_batch():
    # a million tails in a few seconds (as column expressions two hundred steps were interpreted row by row, some minutes for as many)
    t, df = np.tile([0.05, -0.3, 1.96, -4.0, 30.0], 200_000), np.repeat([1.0, 3.0, 30.0, 500.0], 250_000)
    got = evaluate._tails(t, df, 200)
    assert got.shape == t.shape and ((got > 0) & (got < 1)).all()
    for k in (0, 300_002, 600_003, 999_994):
        assert abs(got[k] - by_integration(t[k], df[k])) < 1e-9
    # rows that are done early and late ones don't touch each other
    assert (evaluate._tails(t[::-1], df[::-1], 200)[::-1] == got).all()
