"""Experts' ballots, market and model in one score, and reports on candidates and on the market's part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swissline.operators.backtest import composite
from swissline.operators.durable import stored

# fixed values: weights of the signals
WEIGHTS = {"experts": 0.30, "strength": 0.20, "model": 0.50}
# fixed values: by category, least share of ballots, market bound (an upper one for 0-3), and least model probability (None: among the four highest)
AGREE = {"3-0": (0.20, 0.55, None), "0-3": (0.20, 0.45, None), "advance": (0.50, 0.50, 0.55)}
# fixed values: by category, weight of missing samples and of a substitute, and the bound of the factor
AVAILABILITY = {"3-0": (-0.12, -0.08, 0.84), "0-3": (0.04, 0.03, 1.08), "advance": (-0.05, -0.04, 0.90)}
# fixed values: how many of the signals agree
TIERS = ("Low", "Low", "Medium", "High")
SWING = 0.04

TASK_ROWS = 1 << 19  # rows of a task: the number of tasks grows with the input, so that what a task holds doesn't


def _tasks(rows: int) -> int:
    return max(8, -(-rows // TASK_ROWS))


def vote_shares(ballots: DataFrame, *group: str) -> DataFrame:
    """Share of a group's ballots (group, ballot, team, category) for each team and category; who is picked for 3-0 is picked to advance as well."""
    n = stored(ballots.groupBy(*group).agg(F.count_distinct("ballot").alias("n"), F.count("*").alias("rows")), "ballots")
    ballots = ballots.repartition(_tasks(n.agg(F.sum("rows")).first()[0] or 0), *group, "team")
    both = F.when(F.col("category") == "3-0", F.array(F.lit("3-0"), F.lit("advance"))).otherwise(F.array("category"))
    votes = ballots.withColumn("category", F.explode(both)).groupBy(*group, "team", "category").agg(F.count_distinct("ballot").alias("votes"))
    return votes.join(n.drop("rows"), list(group)).select(*group, "team", "category", (F.col("votes") / F.col("n")).alias("experts"))


def _by_category(of: dict) -> Column:
    out = None
    for category, x in of.items():
        out = F.when(F.col("category") == category, x) if out is None else out.when(F.col("category") == category, x)
    return out


def availability() -> Column:
    """Factor for a team with few samples or a substitute: below 1 but for 0-3. Unknown confidence changes nothing."""
    few, substitute = 1 - F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)), (F.coalesce(F.col("substitute"), F.lit(0)) >= 1).cast("double")
    each = {c: (F.least if a > 0 else F.greatest)(F.lit(bound), 1 + few * a + substitute * b) for c, (a, b, bound) in AVAILABILITY.items()}
    return F.when(F.col("confidence").isNull(), 1.0).otherwise(_by_category(each))


def fused(candidates: DataFrame, shares: DataFrame, *group: str) -> DataFrame:
    """Score, agreeing signals, tier, margin to the next and swing for each candidate (group, team, category, market, model, confidence, substitute).

    Signals are scaled within the group's category. A team without ballots has share 0; ties go to the lower team.
    """
    keys, tasks = [*group, "team", "category"], _tasks(candidates.count())
    rows = candidates.repartition(tasks, *keys).join(shares.repartition(tasks, *keys), keys, "left").fillna(0.0, ["experts"]).repartition(tasks, *group)
    rows = rows.withColumn("strength", F.when(F.col("category") == "0-3", 1 - F.col("market")).otherwise(F.col("market")))
    rows = composite(rows, [*group, "category"], WEIGHTS).withColumn("score", F.col("composite") * availability())
    within = Window.partitionBy(*group, "category")
    high = F.rank().over(within.orderBy(F.desc("model"))) <= 4
    signs = {}
    for c, (votes, bound, model) in AGREE.items():
        market = F.col("market") <= bound if c == "0-3" else F.col("market") >= bound
        signs[c] = sum(x.cast("int") for x in (F.col("experts") >= votes, market, high if model is None else F.col("model") >= model))
    margin = F.col("score") - F.lead("score").over(within.orderBy(F.desc("score"), "team"))
    out = rows.withColumns({"agreeing": _by_category(signs), "margin": margin})
    return out.withColumns({"tier": F.element_at(F.array(*map(F.lit, TIERS)), F.col("agreeing") + 1), "swing": F.coalesce(F.col("margin") < SWING, F.lit(False)).cast("int")})


def scoreboard(candidates: DataFrame, *group: str) -> DataFrame:
    """Counts by state, and what was missed, for each group's category (team, category, selected, state, adjusted_rank). A group's teams are one stage's, so their list is short."""
    on = lambda state: F.col("state") == state
    missed = ~F.col("selected") & on("locked")
    return candidates.groupBy(*group, "category").agg(
        F.count("*").alias("candidates"), F.count_if("selected").alias("selected"), F.count_if(F.col("selected") & on("locked")).alias("selected_locked"),
        F.count_if(F.col("selected") & on("broken")).alias("selected_broken"), F.count_if(missed).alias("missed"), F.min(F.when(missed, F.col("adjusted_rank"))).alias("best_missed_rank"),
        F.array_join(F.sort_array(F.collect_list(F.when(missed, F.col("team")))), ",").alias("missed_teams"), *(F.count_if(on(s)).alias(s) for s in ("locked", "alive", "broken", "missing")),
    )


def market_adjustments(matchups: DataFrame) -> DataFrame:
    """How many matchups have a signal or were adjusted, in all and by name (basis, proxy, applied, source); what never occurs has no row."""
    signal, proxy, applied = F.col("basis").isNotNull(), F.coalesce(F.col("proxy"), F.lit(False)), F.coalesce(F.col("applied"), F.lit(False))
    said = {
        ("cached", ""): F.lit(True), ("adjusted", ""): applied, ("unadjusted", ""): ~applied, ("signal", ""): signal, ("proxy_signal", ""): signal & proxy,
        ("adjusted_by", "source"): applied, ("signal_by", "basis"): signal,
    }
    each = F.array(*(F.struct(F.lit(k).alias("measure"), (F.coalesce(F.col(c), F.lit("unknown")) if c else F.lit("")).alias("name"), on.alias("on")) for (k, c), on in said.items()))
    return matchups.select(F.explode(each).alias("s")).filter("s.on").groupBy("s.measure", "s.name").agg(F.count("*").alias("n"))
