"""Replaying past decisions with a model of their own time: one case a cut-off, each judged by what was known before it.

A case's model is a linear discriminant, whose fit needs only counts, sums and products of the features by class. These are summed
once by day; what stands before a cut-off is a running sum over days. So all cases' models come from one pass over the rows, however
many cases there are, and equal what a fit on each case's earlier rows alone would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _names(features: list[str]) -> list[str]:
    k = range(len(features))
    return ["n", "n1", *(f"s{i}" for i in k), *(f"t{i}" for i in k), *(f"q{i}_{j}" for i in k for j in k if j >= i)]


def daily_sums(rows: DataFrame, features: list[str], label: str = "label", day: str = "day") -> DataFrame:
    """Of each day: n rows, n1 with label 1, sums of each feature (s) and of those with label 1 (t), sums of products (q). Rows with a null
    in a feature or the label take no part."""
    x, one = [F.col(c).cast("double") for c in features], F.col(label) == 1
    k = range(len(x))
    sums = [F.count("*").cast("double").alias("n"), F.count_if(one).cast("double").alias("n1"), *(F.sum(x[i]).alias(f"s{i}") for i in k), *(F.sum(F.when(one, x[i]).otherwise(0.0)).alias(f"t{i}") for i in k)]
    return rows.dropna(subset=[*features, label, day]).groupBy(F.col(day).alias("day")).agg(*sums, *(F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in k for j in k if j >= i))


def sums_before(daily: DataFrame, cuts: DataFrame, most_days: int | None = None) -> DataFrame:
    """For each of ``cuts`` (day), the sums of the days before it, of the last ``most_days`` alone if given. The window runs over days and cuts, not rows."""
    names = [c for c in daily.columns if c != "day"]
    line = daily.withColumn("_cut", F.lit(False)).unionByName(cuts.select("day").distinct().withColumn("_cut", F.lit(True)), allowMissingColumns=True)
    before = Window.orderBy("day").rangeBetween(-most_days if most_days else Window.unboundedPreceding, -1)
    held = line.select("day", "_cut", *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in names))
    return held.filter("_cut").drop("_cut")


def discriminants(sums: DataFrame, features: list[str], ridge: float = 1e-6) -> DataFrame:
    """day, n, weights, bias of the model of each row of sums; where one class is missing the share of label 1 (half a row added to either class) stands for all."""
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            n, n1 = d["n"].to_numpy(), d["n1"].to_numpy()
            s, t = (d[[f"{c}{i}" for i in range(k)]].to_numpy() for c in "st")
            q = np.zeros((len(d), k, k))
            for i, j in pairs:
                q[:, i, j] = q[:, j, i] = d[f"q{i}_{j}"]
            n0 = n - n1
            both = (n1 > 0) & (n0 > 0)
            m1, m0 = t / np.maximum(n1, 1)[:, None], (s - t) / np.maximum(n0, 1)[:, None]
            spread = (q - n1[:, None, None] * m1[:, :, None] * m1[:, None] - n0[:, None, None] * m0[:, :, None] * m0[:, None]) / np.maximum(n, 1)[:, None, None] + ridge * np.eye(k)
            w = np.linalg.solve(np.where(both[:, None, None], spread, np.eye(k)), (m1 - m0)[:, :, None])[:, :, 0]
            w[~both] = 0.0
            bias = np.where(both, np.log(np.maximum(n1, 0.5) / np.maximum(n0, 0.5)), np.log((n1 + 0.5) / (n0 + 0.5))) - 0.5 * ((m1 + m0) * w).sum(1)
            yield pd.DataFrame({"day": d["day"], "n": n, "weights": list(w), "bias": bias})

    return sums.mapInPandas(fit, "day long, n double, weights array<double>, bias double")


def replayed(rows: DataFrame, cases: DataFrame, features: list[str], most_days: int | None = None, label: str = "label") -> DataFrame:
    """``cases`` with ``p`` and ``trained`` (rows known at their cut-off). cases: case_id, day, the features, and what else is carried."""
    models = discriminants(sums_before(daily_sums(rows, features, label), cases, most_days), features)
    score = sum((F.get("weights", i) * F.col(c).cast("double") for i, c in enumerate(features)), F.col("bias"))
    return cases.join(models, "day").withColumn("p", 1 / (1 + F.exp(-score))).withColumn("trained", F.col("n").cast("long")).drop("weights", "bias", "n")


def case_reports(scored: DataFrame, share: float = 0.5, label: str = "label") -> DataFrame:
    """Of each case: rows it was trained on, picks, hits, and whether at least ``share`` of the picks hit."""
    hit = (F.col("p") >= 0.5) == (F.col(label) == 1)
    each = scored.groupBy("case_id").agg(F.max("trained").alias("trained"), F.count("p").alias("picks"), F.count_if(hit).alias("hits"))
    return each.withColumn("passed", (F.col("hits") >= share * F.col("picks")).cast("int"))


def suite_report(cases: DataFrame, target: float = 0.38) -> DataFrame:
    """Cases, those that passed, their share, and whether it reaches the target."""
    out = cases.agg(F.count("*").alias("cases"), F.coalesce(F.sum("passed"), F.lit(0)).alias("passed")).withColumn("pass_rate", F.coalesce(F.col("passed") / F.nullif("cases", F.lit(0)), F.lit(0.0)))
    return out.withColumn("meets", (F.col("pass_rate") >= target).cast("int"))
