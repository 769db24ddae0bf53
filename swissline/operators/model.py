"""Win-probability models: an ensemble of Spark ML members, weights by validation loss, and calibration of its output."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swissline.operators.evaluate import log_loss


def members(seed: int = 53) -> dict:
    return {
        "logistic": LogisticRegression(regParam=0.001, maxIter=50),
        "forest": RandomForestClassifier(numTrees=30, maxDepth=6, minInstancesPerNode=3, maxBins=17, seed=seed),
        "boosting": GBTClassifier(maxIter=15, stepSize=0.08, maxDepth=4, subsamplingRate=0.8, maxBins=17, seed=seed),
    }


def ensemble(train: DataFrame, validation: DataFrame, rows: DataFrame, columns: list[str], label: str = "label") -> tuple[DataFrame, dict[str, float]]:
    """``rows`` with each member's probability and their blend ``p``; weights go by the inverse of validation loss."""
    to_vector = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep")
    fitted = {k: m.setFeaturesCol("_x").setLabelCol(label).fit(to_vector.transform(train)) for k, m in members().items()}

    def scored(df: DataFrame) -> DataFrame:
        df = to_vector.transform(df)
        for k, m in fitted.items():
            df = m.setPredictionCol("_c").setProbabilityCol("_p").setRawPredictionCol("_r").transform(df).withColumn(f"p_{k}", vector_to_array("_p")[1]).drop("_c", "_p", "_r")
        return df.drop("_x")

    loss = scored(validation).agg(*(F.avg(log_loss(F.col(f"p_{k}"), F.col(label))).alias(k) for k in fitted)).first().asDict()
    total = sum(1 / v for v in loss.values())
    weights = {k: 1 / v / total for k, v in loss.items()}
    return scored(rows).withColumn("p", sum((F.col(f"p_{k}") * w for k, w in weights.items()), F.lit(0.0))), weights


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(q / (1 - q))


def _logistic(rows: DataFrame, design: list[Column], start: list[float], ridge: list[float], steps: int = 12) -> list[float]:
    """Coefficients of a logistic fit of ``label``, each drawn to its start by its ridge: Newton steps whose sums are aggregates over all rows."""
    c, y, k = np.array(start, float), F.col("label"), range(len(design))
    for _ in range(steps):
        q = 1 / (1 + F.exp(-sum((x * float(w) for x, w in zip(design, c)), F.lit(0.0))))
        s = rows.agg(F.count("*").alias("n"), *(F.sum((q - y) * design[i]).alias(f"g{i}") for i in k), *(F.sum(q * (1 - q) * design[i] * design[j]).alias(f"h{i}_{j}") for i in k for j in k if j >= i)).first()
        if not s.n:
            break
        pull = np.array(ridge) * s.n
        h = np.array([[s[f"h{min(i, j)}_{max(i, j)}"] for j in k] for i in k]) + np.diag(pull + 1e-9)
        step = np.linalg.solve(h, np.array([s[f"g{i}"] for i in k]) + pull * (c - np.array(start)))
        c = c - step
        if np.abs(step).max() < 1e-9:
            break
    return [float(x) for x in c]


def platt(rows: DataFrame, ridge: float = 1e-3) -> tuple[float, float]:
    """(a, b) of sigmoid(a * logit(p) + b), slope drawn to one."""
    a, b = _logistic(rows, [_logit(F.col("p")), F.lit(1.0)], [1.0, 0.0], [ridge, 0.0])
    return a, b


def temperature(rows: DataFrame) -> float:
    """Slope alone."""
    return _logistic(rows, [_logit(F.col("p"))], [1.0], [0.0])[0]


def beta(rows: DataFrame, ridge: float = 1e-3) -> tuple[float, float, float]:
    """(a, b, c) of sigmoid(a * ln p - b * ln(1 - p) + c); a and b are not negative: one that would be is left out and the rest fitted again."""
    p = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    terms = {"a": F.ln(p), "b": -F.ln(1 - p)}
    while True:
        *slopes, c = _logistic(rows, [*terms.values(), F.lit(1.0)], [1.0] * len(terms) + [0.0], [ridge] * len(terms) + [0.0])
        found = dict(zip(terms, slopes))
        low = min(found, key=found.get, default=None)
        if low is None or found[low] >= 0:
            return found.get("a", 0.0), found.get("b", 0.0), c
        del terms[low]


def beta_calibrated(p: Column, a: float, b: float, c: float) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(a * F.ln(q) - b * F.ln(1 - q) + c)))


def calibration_losses(rows: DataFrame, time: str = "day", folds: int = 2) -> DataFrame:
    """Log loss of each method on rows after those it was fitted on, over expanding folds by time; the least first. Folds end at
    percentiles of ``time``, so rows of one time are never split."""
    cuts = rows.agg(F.percentile(time, F.array(*(F.lit(k / (folds + 1)) for k in range(1, folds + 2))))).first()[0]
    parts, held = [], rows.select(time, "p", "label").persist()  # while fitting only
    for k in range(folds) if cuts else []:
        before, after = held.filter(F.col(time) <= cuts[k]), rows.filter((F.col(time) > cuts[k]) & (F.col(time) <= cuts[k + 1]))
        tried = {"raw": F.col("p"), "platt": calibrated(F.col("p"), *platt(before)), "temperature": calibrated(F.col("p"), temperature(before)), "beta": beta_calibrated(F.col("p"), *beta(before))}
        parts.append(after.select(F.inline(F.array(*(F.struct(F.lit(m).alias("method"), log_loss(q, F.col("label")).alias("loss")) for m, q in tried.items())))))
    held.unpersist()
    if not parts:
        return rows.sparkSession.createDataFrame([], "method string, loss double, n long")
    return reduce(DataFrame.unionByName, parts).groupBy("method").agg(F.avg("loss").alias("loss"), F.count("*").alias("n")).orderBy("loss", "method")


def calibrated(p: Column, a: float, b: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-(a * _logit(p) + b)))
