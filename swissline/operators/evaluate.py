"""Evaluation of probabilities: metrics, calibration, bootstrap and tests. Input: label (0/1), p, and any segment columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swissline.operators.splits import before_ranges, in_ranges, ranked


def log_loss(p: Column, label: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return -F.when(label == 1, F.ln(q)).otherwise(F.ln(1 - q))


def by_segment(rows: DataFrame, segment: str) -> DataFrame:
    """Metrics of each segment and of all rows, in one pass of grouping sets."""
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("label")).cast("double")
    out = rows.rollup(segment).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(log_loss(F.col("p"), F.col("label"))).alias("log_loss"), F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2.0))).alias("brier"))
    return out.withColumn(segment, F.coalesce(F.col(segment).cast("string"), F.lit("all")))


def auc(rows: DataFrame) -> DataFrame:
    """By ranks with ties at one half: counts by distinct p, then running sums over those."""
    each = in_ranges(rows.groupBy("p").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")), "p")
    inner = F.sum("neg").over(Window.partitionBy("_part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(inner, F.lit(0)) + before_ranges(each, F.sum("neg"))
    total = each.withColumn("won", F.col("pos") * (before + F.col("neg") / 2.0)).agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return total.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos") * F.col("neg"))).otherwise(F.lit(0.5)).alias("auc"))


def brier_skill(rows: DataFrame, baseline: Column) -> DataFrame:
    """1 - Brier / Brier of the baseline, and of the constant rate of label 1; 0 where that is 0."""
    square = lambda x: F.avg(F.pow(x - F.col("label"), F.lit(2.0)))
    a = rows.agg(square(F.col("p")).alias("own"), square(baseline).alias("other"), F.avg("label").alias("rate"))
    skill = lambda b: F.when(b == 0, 0.0).otherwise(1 - F.col("own") / F.nullif(b, F.lit(0.0)))
    return a.select(skill(F.col("other")).alias("skill"), skill(F.col("rate") * (1 - F.col("rate"))).alias("over_rate"))


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    each = rows.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("rate"))
    return rows.sparkSession.range(bins).withColumnRenamed("id", "bin").join(each, "bin", "left").fillna({"n": 0})


def murphy(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Reliability, resolution and uncertainty of the Brier score."""
    each = calibration_bins(rows, bins).filter("n > 0")
    whole = Window.partitionBy()
    base = F.sum(F.col("rate") * F.col("n")).over(whole) / F.sum("n").over(whole)
    e = each.withColumn("base", base)
    share = F.col("n") / F.sum("n").over(whole)
    e = e.withColumn("share", share)
    return e.agg(F.sum(F.col("share") * F.pow(F.col("mean_p") - F.col("rate"), F.lit(2.0))).alias("reliability"), F.sum(F.col("share") * F.pow(F.col("rate") - F.col("base"), F.lit(2.0))).alias("resolution"), F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def ece_equal_mass(rows: DataFrame, key: str, bins: int = 10) -> DataFrame:
    """Bins by place in the order of (p, label): place * bins div n."""
    n = rows.count()
    placed = ranked(rows, "p", "label", key).withColumn("bin", F.expr(f"(place - 1) * {bins} div {max(1, n)}"))
    gaps = placed.groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("label")).alias("gap"))
    return gaps.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def _drawn(rows: DataFrame, key: str, samples: int, values: dict[str, Column]) -> DataFrame:
    """Means of the values in each sample. Counts of each row in a sample are drawn from md5(sample | key), so no row moves: each task adds up its part of all samples."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("sample").cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    # Poisson(1) by inversion
    times = F.lit(0)
    for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183):
        times = times + F.when(u >= c, 1).otherwise(0)
    drawn = rows.select(key, *(v.alias(k) for k, v in values.items()), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample")).withColumn("_k", times)
    return drawn.groupBy("sample").agg(*((F.sum(F.col(k) * F.col("_k")) / F.sum("_k")).alias(k) for k in values))


def bootstrap(rows: DataFrame, key: str, samples: int, value: Column, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a mean; ``key`` may name a cluster, whose rows are then drawn together."""
    means = _drawn(rows, key, samples, {"mean": value})
    return means.agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std"), F.percentile("mean", F.lit(alpha / 2)).alias("low"), F.percentile("mean", F.lit(1 - alpha / 2)).alias("high"))


def paired_bootstrap(rows: DataFrame, key: str, samples: int, a: Column, b: Column, alpha: float = 0.05) -> DataFrame:
    """Difference of two mean losses on the same samples, its interval, a two-sided p and which is better: a, b or tie."""
    d = _drawn(rows, key, samples, {"d": a - b})
    share = lambda on: F.avg(on.cast("double"))
    found = d.agg(F.percentile("d", F.lit(alpha / 2)).alias("low"), F.percentile("d", F.lit(1 - alpha / 2)).alias("high"), F.least(F.lit(1.0), 2 * F.least(share(F.col("d") <= 0), share(F.col("d") >= 0))).alias("p_value"))
    out = rows.agg(F.avg(a - b).alias("delta")).join(F.broadcast(found))  # one row each
    return out.withColumn("better", F.when((F.col("low") <= 0) & (F.col("high") >= 0), "tie").when(F.col("delta") < 0, "a").otherwise("b"))


def diebold_mariano(rows: DataFrame, key: str, lag: int = 1) -> DataFrame:
    """Statistic of loss differences of p and p2 with Newey-West variance of the given lag and small-sample correction."""
    d = rows.select(key, (F.pow(F.col("p") - F.col("label"), F.lit(2.0)) - F.pow(F.col("p2") - F.col("label"), F.lit(2.0))).alias("d"))
    # the rows before the first ones of a range are the last ones of the range before
    ranges = in_ranges(d, key)
    w = Window.partitionBy("_part").orderBy(key)
    if lag > 1:
        tail = ranges.withColumn("_back", F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(key)))).filter(F.col("_back") < lag)
        edges: dict[int, list[float]] = {}
        for part, x in tail.orderBy(key).select("_part", "d").collect():  # lag - 1 numbers for each range
            edges.setdefault(part, []).append(x)
        parts, last, before = sorted(edges), [], {}
        for k in parts:
            before[k] = last[::-1]  # the nearest first
            last = (last + edges[k])[-(lag - 1) :]
        carried = F.element_at(F.create_map(*(x for k in parts for x in (F.lit(k), F.array(*map(F.lit, before[k])).cast("array<double>")))), F.col("_part")) if parts else F.array().cast("array<double>")
        place = F.row_number().over(w)
        ranges = ranges.withColumns({"_place": place, "_before": carried})
        of = lambda k: F.when(F.col("_place") > k, F.lag("d", k).over(w)).otherwise(F.get("_before", k - F.col("_place")))
    e = ranges.select("d", *(of(k).alias(f"d{k}") for k in range(1, lag)))
    mean = e.agg(F.avg("d").alias("mean"), F.count("*").alias("n"))
    e = e.join(F.broadcast(mean))  # one row
    gamma0 = F.avg(F.pow(F.col("d") - F.col("mean"), F.lit(2.0)))
    var = gamma0
    for k in range(1, lag):
        var = var + 2 * (1 - k / lag) * F.sum((F.col("d") - F.col("mean")) * (F.col(f"d{k}") - F.col("mean"))) / F.max("n")
    out = e.agg(F.max("n").alias("n"), F.max("mean").alias("mean"), var.alias("var"))
    n, h = F.col("n"), lag
    return out.select("n", F.col("mean").alias("mean_difference"), (F.col("mean") / F.sqrt(F.col("var") / n) * F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)).alias("statistic"))


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling's series eight places up, and back by the recurrence."""
    up = z + 8
    series = 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5) - 1 / (1680 * up**7) + 1 / (1188 * up**9)
    product = z.copy()
    for i in range(1, 8):
        product *= z + i
    return (up - 0.5) * np.log(up) - up + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """The continued fraction 1 + n1 / (1 + n2 / (1 + ...)) of the incomplete beta function, forwards. A row is done when a pair of
    steps changes nothing that a double can hold."""
    safe = lambda v: np.where(np.abs(v) < 1e-30, 1e-30, v)
    out, c, d, h = np.ones(len(x)), np.ones(len(x)), np.zeros(len(x)), np.ones(len(x))
    at = np.arange(len(x))
    for k in range(1, steps + 1):
        m = k // 2
        if k % 2:
            if k > 1:
                moving = np.abs(h - last) > 1e-16 * np.abs(h)
                if not moving.all():
                    out[at] = h
                    at, x, a, b, c, d, h = (v[moving] for v in (at, x, a, b, c, d, h))
                    if not len(at):
                        break
            last = h
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        c, d = safe(1 + n / c), 1 / safe(1 + n * d)
        h = h * d * c
    out[at] = h
    return out


def _tails(t: np.ndarray, df: np.ndarray, steps: int) -> np.ndarray:
    """``student_t_tail`` of arrays with df above 0 and t other than 0."""
    t2, a = t * t, df / 2
    x, y, half = df / (df + t2), t2 / (df + t2), np.full(len(t), 0.5)
    near = x < (a + 1) / (a + 2.5)
    x, y, a, b = np.where(near, x, y), np.where(near, y, x), np.where(near, a, half), np.where(near, half, a)
    front = np.exp(a * np.log(x) + b * np.log(y) - (_log_gamma(a) + _log_gamma(b) - _log_gamma(a + b))) / a
    tail = front / _fraction(x, a, b, steps)
    return np.clip(np.where(near, tail, 1 - tail), 0.0, 1.0)


def student_t_tail(t: Column, df: Column, steps: int = 200) -> Column:
    """P(|T| > |t|) of Student's distribution: the incomplete beta function of df / (df + t * t), by its continued fraction from whichever
    end it converges fast. Null without degrees of freedom above 0."""

    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        x, n = t.to_numpy(float), df.to_numpy(float)
        out = np.where(np.isinf(x), 0.0, 1.0)
        some = (n > 0) & (x != 0) & ~np.isinf(x)
        with np.errstate(all="ignore"):
            out[some] = _tails(x[some], n[some], steps)
        return pd.Series(out)

    found = F.pandas_udf(run, "double")(t.cast("double"), df.cast("double"))
    return F.when((df > 0) & t.isNotNull(), found)


def diebold_mariano_test(rows: DataFrame, key: str, lag: int = 1) -> DataFrame:
    """``diebold_mariano`` with the two-sided p-value on n - 1 degrees of freedom."""
    return diebold_mariano(rows, key, lag).withColumn("p_value", student_t_tail(F.col("statistic"), F.col("n") - 1))
