"""What-if policies and diagnostics of settled forecasts. Input: p, market, label, form_diff, form_confidence, substitute and the like.

Each report is one aggregation in one pass over the rows: every setting adds columns, no row is sent once for each setting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swissline.operators.backtest import THRESHOLDS, correct, margin, thresholds

# fixed values: settings that are tried
FORM_CONFIDENCES = (0.0, 0.2, 0.4, 0.6, 0.8)
FAVOURITE_PROBABILITIES = (0.55, 0.60, 0.65, 0.70)
STATUS_CONFIDENCES = (0.2, 0.4, 0.6)
STATUS_MARGINS = (0.06, 0.08, 0.10)
MATCH_TYPES = ("advancement", "elimination", "standard", "unknown")


def form_score() -> Column:
    """Player form seen from the team that the forecast favours."""
    return F.when(F.col("p") >= 0.5, F.col("form_diff")).otherwise(-F.col("form_diff"))


def actionable(minimum: float = 0.02) -> Column:
    return F.coalesce(margin() >= minimum, F.lit(False))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _outcome(on: Column, avoided: Column) -> list[Column]:
    """Of the rows ``on``, what stays and what a rule avoids."""
    left = on & ~avoided
    n, hits = F.count_if(left), F.count_if(left & correct())
    return [
        F.count_if(on & avoided).alias("avoided"), n.alias("picks"), hits.alias("hits"), _ratio(hits, n).alias("accuracy"), _ratio(n, F.count_if(on)).alias("coverage"),
        F.count_if(on & avoided & correct()).alias("avoided_wins"), F.count_if(on & avoided & ~correct()).alias("avoided_losses"),
    ]


def _grid(rows: DataFrame, settings: list[list[Column]]) -> DataFrame:
    return rows.agg(F.array(*(F.struct(*s) for s in settings)).alias("s")).select(F.inline("s"))


def form_policies(rows: DataFrame, confidences: tuple[float, ...] = FORM_CONFIDENCES) -> DataFrame:
    """Avoid picks against a form signal of at least so much confidence."""
    against = lambda c: F.coalesce((form_score() < 0) & (F.col("form_confidence") >= c), F.lit(False))
    return _grid(rows, [[F.lit(float(c)).alias("confidence"), *_outcome(F.lit(True), against(c))] for c in confidences])


def favourite_policies(rows: DataFrame, probabilities: tuple[float, ...] = FAVOURITE_PROBABILITIES, minimum: float = 0.02) -> DataFrame:
    """Avoid market favourites of at least so much probability whose form speaks against them."""
    same = (F.col("p") >= 0.5) == (F.col("market") >= 0.5)
    against = lambda x: F.coalesce(same & (F.greatest("market", 1 - F.col("market")) >= x) & (form_score() < 0), F.lit(False))
    return _grid(rows, [[F.lit(float(x)).alias("probability"), *_outcome(actionable(minimum), against(x))] for x in probabilities])


def status_risk(confidence: float) -> tuple[Column, Column]:
    """(few samples, substitute) of the picked team; unknown is no risk."""
    return F.coalesce(F.col("form_confidence") < confidence, F.lit(False)), F.coalesce(F.col("substitute") >= 1, F.lit(False))


def status_policies(rows: DataFrame, confidences: tuple[float, ...] = STATUS_CONFIDENCES, margins: tuple[float, ...] = STATUS_MARGINS, minimum: float = 0.02) -> DataFrame:
    """Avoid picks of a small margin whose players are a risk; every pair of settings."""
    settings = []
    for c in confidences:
        few, sub = status_risk(c)
        for m in margins:
            near = actionable(minimum) & (margin() <= m)
            settings.append([F.lit(float(c)).alias("confidence"), F.lit(float(m)).alias("margin"), F.count_if(near & sub).alias("substitutes"), F.count_if(near & few).alias("low_samples"), *_outcome(actionable(minimum), near & (few | sub))])
    return _grid(rows, settings)


def status_summary(rows: DataFrame, confidence: float = 0.4, minimum: float = 0.02) -> DataFrame:
    """Risky and other picks, picked and avoided; accuracies are null where there is no row."""
    few, sub = status_risk(confidence)
    known = F.col("form_confidence").isNotNull() | F.col("substitute").isNotNull()
    risky, on = few | sub, known & actionable(minimum)
    return rows.agg(
        F.count_if(known).alias("available"), F.count_if(~known).alias("missing"), F.count_if(on & risky).alias("risky_picks"), F.count_if(on & few).alias("low_samples"), F.count_if(on & sub).alias("substitutes"),
        F.avg(F.when(on & risky, correct().cast("double"))).alias("risky_accuracy"), F.count_if(on & ~risky).alias("other_picks"), F.avg(F.when(on & ~risky, correct().cast("double"))).alias("other_accuracy"),
        F.count_if(known & ~actionable(minimum) & risky & correct()).alias("avoided_wins"), F.count_if(known & ~actionable(minimum) & risky & ~correct()).alias("avoided_losses"),
    )


def counter_signals(rows: DataFrame) -> DataFrame:
    """Losses where form speaks against the pick, and where it doesn't."""
    known = F.col("form_diff").isNotNull()
    against = known & (form_score() < 0)
    aligned = known & (form_score() >= 0)
    lost = lambda on: F.count_if(on & ~correct())
    return rows.agg(
        F.count_if(known).alias("available"), F.count_if(against).alias("counter"), lost(against).alias("counter_losses"), _ratio(lost(against), F.count_if(against)).alias("counter_loss_rate"),
        F.count_if(aligned).alias("aligned"), lost(aligned).alias("aligned_losses"), _ratio(lost(aligned), F.count_if(aligned)).alias("aligned_loss_rate"),
    )


def form_by_outcome(rows: DataFrame, minimum: float = 0.02) -> DataFrame:
    """Mean form difference of hits and misses, of all rows and of picks."""
    mean = lambda on: F.avg(F.when(on, F.col("form_diff")))
    return rows.agg(
        F.count("form_diff").alias("available"), mean(actionable(minimum) & correct()).alias("picked_hits"), mean(actionable(minimum) & ~correct()).alias("picked_misses"),
        mean(correct()).alias("hits"), mean(~correct()).alias("misses"), F.avg(F.when(~correct(), F.col("form_confidence"))).alias("misses_confidence"),
    )


def pressure_buckets(rows: DataFrame, kind: str = "kind", minimum: float = 0.02) -> DataFrame:
    """By type of match; the four types come even without rows."""
    on = actionable(minimum)
    each = rows.groupBy(kind).agg(
        F.count("*").alias("n"), F.count_if(on).alias("picks"), F.count_if(on & correct()).alias("hits"), _ratio(F.count_if(on & correct()), F.count_if(on)).alias("accuracy"),
        F.count_if(correct()).alias("directional"), F.avg(margin()).alias("margin"),
    )
    fixed = rows.sparkSession.createDataFrame([(t,) for t in MATCH_TYPES], f"{kind} string")
    return each.join(fixed, kind, "full").fillna(0, ["n", "picks", "hits", "directional"]).fillna(0.0, ["accuracy"])


def recommended_threshold(rows: DataFrame, margins: tuple[float, ...] = THRESHOLDS, least_picks: int = 2) -> DataFrame:
    """The most accurate threshold with enough picks, then the most hits, then the smaller one; no row if none has enough."""
    tried = thresholds(rows, margins).filter(F.col("picks") >= least_picks)
    best = tried.agg(F.max_by(F.struct("threshold", "picks", "correct"), F.struct(F.col("correct") / F.col("picks"), F.col("correct"), -F.col("threshold"))).alias("b"))
    return best.select("b.*").filter("threshold is not null")


def checkpoint_pressure(picks: DataFrame, state: str = "state") -> DataFrame:
    """How far each pick is from locking and breaking, and whether the next match can do it. Records may be null: then so are the distances."""
    w, n, kind, alive = F.col("wins"), F.col("losses"), F.col("category"), F.col(state) == "alive"
    up, down = kind.isin("3-0", "advance"), kind == "0-3"
    to = lambda most, x: F.greatest(F.lit(0), most - x).cast("long")
    distance = lambda on, most, x: F.when(on & x.isNotNull(), to(most, x))
    can = lambda on: F.coalesce(alive & on, F.lit(False)).cast("int")
    return picks.withColumns({
        "wins_to_lock": distance(up, F.lit(3), w), "losses_to_lock": distance(down, F.lit(3), n),
        "losses_to_break": distance(up, F.when(kind == "3-0", 1).otherwise(3), n), "wins_to_break": distance(down, F.lit(1), w),
        "can_lock": can((up & (w == 2)) | (down & (n == 2))), "can_break": can(((kind == "3-0") & (n == 0)) | ((kind == "advance") & (n == 2)) | (down & (w == 0))),
    })


def checkpoint_summary(picks: DataFrame, state: str = "state") -> DataFrame:
    """Picks of each category by state, with mean confidence, risks and pressure. Needs confidence, tier and risk (boolean)."""
    s = F.col(state)
    at = lambda x: s == x
    risk = F.coalesce("risk", F.lit(False))
    pressed = at("alive") & ((F.col("can_lock") == 1) | (F.col("can_break") == 1))
    broken = at("broken").cast("double")
    return picks.groupBy("category").agg(
        F.count("*").alias("picks"), F.avg("confidence").alias("confidence"), *(F.count_if(at(x)).alias(x) for x in ("locked", "alive", "broken", "missing")),
        F.count_if(at("broken") & (F.lower("tier") == "high")).alias("high_tier_broken"), F.count_if(risk).alias("risky"), F.avg(F.when(risk, broken)).alias("risky_broken_rate"), F.avg(F.when(~risk, broken)).alias("other_broken_rate"),
        F.count_if(pressed).alias("pressed"), F.count_if(pressed & risk).alias("risky_pressed"),
    )
