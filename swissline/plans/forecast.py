"""Forecast job: history -> form and ratings -> ensemble -> calibration -> market fusion -> decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swissline.operators import backtest, form, market, model, ratings
from swissline.sources.matches import long_form, match_view


def training_rows(matches: DataFrame) -> DataFrame:
    """label and features known before each match."""
    long = long_form(matches)
    rows = matches.select("match_id", "day", "best_of", "odds1", "odds2", (F.col("winner") == F.col("team1")).cast("int").alias("label"))
    wide = long.select("match_id", "side")
    for name, f in (("form", form.recent_winrate(long, 10)), ("map", form.map_winrate(long))):
        wide = wide.join(f.select("match_id", "side", F.col("winrate").alias(name)), ["match_id", "side"])
    diff = wide.groupBy("match_id").agg(*(F.sum(F.when(F.col("side") == 1, F.col(c)).otherwise(-F.col(c))).alias(f"{c}_diff") for c in ("form", "map")))
    elo = ratings.elo(matches).select("match_id", (F.col("elo1") - F.col("elo2")).alias("elo_diff"))
    glicko = ratings.glicko(matches).select("match_id", (F.col("mu1") - F.col("mu2")).alias("glicko_diff"), (F.col("rd1") + F.col("rd2")).alias("rd_sum"))
    return rows.join(diff, "match_id").join(elo, "match_id").join(glicko, "match_id").join(form.h2h(matches), "match_id")


FEATURES = ["form_diff", "map_diff", "elo_diff", "glicko_diff", "rd_sum", "h2h"]


def decisions(spark: SparkSession, sf_dir: str, weight: float = 0.3, minimum: float = 0.02) -> DataFrame:
    """One row for each match of the last tenth of days: model, calibrated, fused probability and pick."""
    rows = training_rows(match_view(spark, sf_dir)).persist()
    cut, end = rows.selectExpr("percentile(day, 0.8)", "percentile(day, 0.9)").first()
    train, held, last = rows.filter(F.col("day") <= cut), rows.filter((F.col("day") > cut) & (F.col("day") <= end)), rows.filter(F.col("day") > end)
    scored, _ = model.ensemble(train, held, held.unionByName(last), FEATURES)
    scored = scored.persist()
    a, b = model.platt(scored.filter(F.col("day") <= end))
    p = model.calibrated(F.col("p"), a, b)
    fused = market.logit_pool(F.col("calibrated"), market.devig_shin(F.col("odds1"), F.col("odds2")), weight)
    out = scored.filter(F.col("day") > end).withColumn("calibrated", p).withColumn("model", F.col("p")).withColumn("p", fused)
    return out.select("match_id", "label", "model", "calibrated", F.col("p").alias("fused"), backtest.pick(minimum).alias("pick"))
