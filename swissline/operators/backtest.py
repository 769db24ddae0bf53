"""Backtests of forecasts: policies, reasons and what-if thresholds. Input: p, market, label, best_of, reason columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: margins that are tried
THRESHOLDS = (0.0, 0.02, 0.05, 0.08, 0.10, 0.12, 0.15)


def margin() -> Column:
    return F.abs(F.col("p") - 0.5)


def correct() -> Column:
    return (F.col("p") >= 0.5) == (F.col("label") == 1)


def pick(minimum: float) -> Column:
    """The live rule avoids at the margin itself."""
    return F.when(F.greatest(F.col("p"), 1 - F.col("p")) <= 0.5 + minimum, "avoid").when(F.col("p") > 0.5, "team1").otherwise("team2")


def avoid_reasons(rows: DataFrame, minimum: float, counter_confidence: float = 0.4) -> DataFrame:
    against = (F.col("form_diff") * (F.col("p") - 0.5) < 0) & (F.col("form_confidence") >= counter_confidence)
    reason = F.when(margin() <= minimum, "low_confidence").when(against, "form_counter_signal").when(pick(minimum) == "avoid", "avoid").otherwise("picked")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.count_if(correct()).alias("correct"))


def thresholds(rows: DataFrame, margins: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """What-if counts keep picks at the margin itself. Rows are counted once by the largest margin they meet, then summed up."""
    level = sum(((margin() >= t).cast("int") for t in margins[1:]), F.lit(0)) if list(margins) == sorted(margins) else None
    each = rows.withColumn("level", F.when(margin() >= margins[0], level)).filter("level is not null").groupBy("level").agg(F.count("*").alias("n"), F.count_if(correct()).alias("c"))
    up = Window.orderBy(F.desc("level"))
    done = each.select("level", F.sum("n").over(up).alias("picks"), F.sum("c").over(up).alias("correct"))
    grid = rows.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(margins)], "level int, threshold double")
    return grid.join(done, "level", "left").select("threshold", F.coalesce("picks", F.lit(0)).alias("picks"), F.coalesce("correct", F.lit(0)).alias("correct"))


def bo1_policy(rows: DataFrame, minimum: float, bo1_minimum: float) -> DataFrame:
    kept = margin() >= F.when(F.col("best_of") == 1, F.lit(bo1_minimum)).otherwise(F.lit(minimum))
    return rows.groupBy("best_of").agg(F.count("*").alias("n"), F.count_if(kept).alias("picks"), F.count_if(kept & correct()).alias("correct"))


def favourite_upsets(rows: DataFrame, least: float = 0.55) -> DataFrame:
    """Favourites by model, by market, and by both."""
    kinds = {"model": F.greatest("p", 1 - F.col("p")) >= least, "market": F.greatest("market", 1 - F.col("market")) >= least}
    kinds["agreement"] = kinds["model"] & kinds["market"] & ((F.col("p") >= 0.5) == (F.col("market") >= 0.5))
    side = {"model": F.col("p"), "market": F.col("market"), "agreement": F.col("p")}
    each = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("on"), ((side[k] >= 0.5) != (F.col("label") == 1)).alias("upset")) for k, v in kinds.items()))
    return rows.select(F.explode(each).alias("s")).filter("s.on").groupBy("s.kind").agg(F.count("*").alias("n"), F.count_if("s.upset").alias("upsets"))


def top_by_policy(rows: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), key)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k)


def composite(rows: DataFrame, group: str, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of min-max scaled signals that are there; a constant signal is 0.5."""
    w, total, weight = Window.partitionBy(group), F.lit(0.0), F.lit(0.0)
    for c, x in weights.items():
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        value = F.when(hi > lo, (F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(F.lit(0.5))
        total = total + F.when(F.col(c).isNotNull(), value * x).otherwise(F.lit(0.0))
        weight = weight + F.when(F.col(c).isNotNull(), F.lit(x)).otherwise(F.lit(0.0))
    return rows.withColumn("composite", total / F.nullif(weight, F.lit(0.0)))


def suite_pass_rate(picks: DataFrame, needed: int = 5) -> DataFrame:
    cases = picks.groupBy("case_id").agg(F.count_if("hit").alias("hits"))
    return cases.agg(F.count("*").alias("n_cases"), F.count_if(F.col("hits") >= needed).alias("passed"), F.avg((F.col("hits") >= needed).cast("double")).alias("pass_rate"))
