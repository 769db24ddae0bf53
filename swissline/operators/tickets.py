"""Tickets: risk-adjusted scores, margins, field probabilities, leveraged reward and swap search over Monte Carlo samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: category, its probability column and its slots, in the order in which a ticket is filled
SLOTS = (("3-0", "p_30", 2), ("0-3", "p_03", 2), ("advance", "p_advance", 6))
UNRANKED = 80


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _or(name: str, teams: DataFrame, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in teams.columns else F.lit(default)


def risk_scores(teams: DataFrame, stage: str = "default", upset_limit: int = 15, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a team and category with the factors of its score. teams: seed_no, p_30, p_03, p_advance, and where known rank, bo1_winrate,
    map_depth, rating, form_score, form_trend, sample_confidence, substitute; what is missing is neutral. by: the columns that name a stage,
    if there are several; a stage has some tens of teams."""
    rank = _or("rank", teams, UNRANKED)
    t = teams.select(
        *by, "seed_no", rank.alias("rank"), (rank - F.min(rank).over(Window.partitionBy(*by))).alias("rank_gap"), _or("bo1_winrate", teams, 0.5).alias("bo1"), _or("map_depth", teams, 0.5).alias("depth"), _or("rating", teams, 1.0).alias("rating"),
        _clip(_or("form_score", teams, 0.0) * 0.12 + _or("form_trend", teams, 0.0) * 0.08, -0.035, 0.035).alias("form"), (1 - _clip(_or("sample_confidence", teams, 1.0), 0.0, 1.0)).alias("unsure"),
        (_or("substitute", teams, 0.0) >= 1).cast("double").alias("sub"), F.explode(F.array(*(F.struct(F.lit(k).alias("category"), F.coalesce(F.col(c), F.lit(0.0)).alias("base")) for k, c, _ in SLOTS))).alias("s"),
    ).select("*", "s.*").drop("s")
    # fixed values: the weights and bounds of the adjustments and factors below
    kind, bottom = F.col("category"), F.col("category") == "0-3"
    early = _clip((F.col("bo1") - 0.5) * 0.10 + (F.col("depth") - 0.5) * 0.08, -0.04, 0.06)
    late = _clip((F.col("rating") - 1) * 0.10 + (UNRANKED - _clip(F.col("rank"), 1, UNRANKED)) / UNRANKED * 0.04, -0.03, 0.06)
    by_stage = {"challengers": early, "opening": early, "legends": late, "elimination": late}.get(stage, F.lit(0.0))
    factors = t.select(
        *by, "seed_no", "category", "rank", "base", F.when(bottom, 0.0).otherwise(by_stage).alias("stage_adjustment"), F.when(bottom, -F.col("form")).otherwise(F.col("form")).alias("form_adjustment"),
        F.when(~bottom & (F.col("rank_gap") > upset_limit), 0.75).otherwise(1.0).alias("upset_factor"), F.when(bottom, 1 + F.least(F.col("rank"), F.lit(UNRANKED)) / 200).otherwise(1.0).alias("weak_factor"),
        F.when(bottom, F.least(F.lit(1.08), 1 + F.col("unsure") * 0.04 + F.col("sub") * 0.03)).when(kind == "3-0", F.greatest(F.lit(0.84), 1 - F.col("unsure") * 0.12 - F.col("sub") * 0.08))
        .otherwise(F.greatest(F.lit(0.90), 1 - F.col("unsure") * 0.05 - F.col("sub") * 0.04)).alias("availability_factor"),
        ((F.col("unsure") > 0.6) | (F.col("sub") > 0)).cast("int").alias("status_risk"),
    )
    return factors.withColumn("score", (F.col("base") + F.col("stage_adjustment") + F.col("form_adjustment")) * F.col("upset_factor") * F.col("weak_factor") * F.col("availability_factor"))


def choose(scores: DataFrame, slots=SLOTS, by: tuple[str, ...] = ()) -> DataFrame:
    """Greedy by score, category after category, no team twice in a stage; ties to the better rank, or to the worse for the bottom."""
    left, out = scores, []
    for category, _, n in slots:
        rank = F.col("rank").desc() if category == "0-3" else F.col("rank")
        order = Window.partitionBy(*by).orderBy(F.desc("score"), rank, "seed_no")
        best = left.filter(F.col("category") == category).withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= n)
        out.append(best.select(*by, "category", "place", "seed_no", "score"))
        left = left.join(best.select(*by, "seed_no"), [*by, "seed_no"], "left_anti")
    return reduce(DataFrame.unionByName, out)


def margins(scores: DataFrame, picks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How far each pick's score is above the best of its category that is picked nowhere."""
    free = scores.join(picks.select(*by, "seed_no"), [*by, "seed_no"], "left_anti").groupBy(*by, "category").agg(F.max("score").alias("next_best"))
    return picks.select(*by, "category", "seed_no", "score").join(free, [*by, "category"], "left").withColumn("margin", F.col("score") - F.col("next_best"))


def outcomes(shares: DataFrame) -> DataFrame:
    """The most likely record of each team, ties to the larger label. shares: seed_no, record, p."""
    best = shares.groupBy("seed_no").agg(F.max_by("record", F.struct("p", "record")).alias("record"), F.max("p").alias("p"), F.sum(F.when(F.col("record").startswith("3-"), F.col("p")).otherwise(0.0)).alias("advance"))
    return best.withColumn("eliminate", 1 - F.col("advance"))


def hit(category: Column) -> Column:
    """Whether a sample's record is that of the category."""
    w, n = F.col("wins"), F.col("losses")
    return F.when(category == "3-0", (w == 3) & (n == 0)).when(category == "0-3", (n == 3) & (w == 0)).otherwise((w == 3) & (n > 0))


def field(samples: DataFrame) -> DataFrame:
    """How often each team hits each category: what the field is taken to get right."""
    each = F.array(*(F.struct(F.lit(k).alias("category"), hit(F.lit(k)).alias("hit")) for k, _, _ in SLOTS))
    return samples.select("seed_no", F.inline(each)).groupBy("seed_no", "category").agg(F.avg(F.col("hit").cast("double")).alias("p"), F.count("*").alias("n"))


def leveraged_reward(samples: DataFrame, picks: DataFrame, strength: float = 1.0, crowd: DataFrame | None = None) -> DataFrame:
    """Expected sum of field probability ** -strength over hits. The mean over samples of a sum of hits is the sum of their shares; the
    probability is at least one sample's. crowd: seed_no, category, p in place of the samples' own."""
    own = field(samples)
    against = own.withColumn("q", F.col("p")) if crowd is None else own.join(crowd.withColumnRenamed("p", "q"), ["seed_no", "category"], "left")
    floor = F.greatest(F.coalesce("q", F.lit(0.5)), 1 / F.col("n"))
    met = picks.select("seed_no", "category").join(against, ["seed_no", "category"])
    return met.agg(F.coalesce(F.sum(F.col("p") * F.pow(1 / floor, F.lit(max(0.0, strength)))), F.lit(0.0)).alias("reward"), F.count("*").alias("picks"))


def by_simulation(samples: DataFrame, teams: int) -> DataFrame:
    """A row for each simulation: the outcome code of each seed (1 for 3-0, 2 for 0-3, 3 for another advance, else 0)."""
    code = F.when(hit(F.lit("3-0")), 1).when(hit(F.lit("0-3")), 2).when(hit(F.lit("advance")), 3).otherwise(0)
    rows = samples.groupBy("sim").agg(*(F.max(F.when(F.col("seed_no") == i, code)).alias(f"s{i}") for i in range(teams)))
    return rows.select(*(F.coalesce(f"s{i}", F.lit(0)).cast("tinyint").alias(f"s{i}") for i in range(teams)))


def swap_search(samples: DataFrame, ticket: list[tuple[str, int]], pool: list[tuple[str, int]], needed: int = 5, most_swaps: int = 64) -> tuple[list[tuple[str, int]], float]:
    """The ticket after improving swaps, and how often it has ``needed`` hits. The first swap in the order of category, position and pool
    that improves is made, until none does. The driver holds the ticket alone; each round is one aggregation that scores all swaps.

    ticket, pool: (category, seed) of the ten picks and of the candidates, best first."""
    codes = {"3-0": 1, "0-3": 2, "advance": 3}
    teams = 1 + max(s for _, s in [*ticket, *pool])
    sims = by_simulation(samples, teams).persist()
    on = lambda pick: (F.col(f"s{pick[1]}") == codes[pick[0]]).cast("int")
    order = {k: i for i, (k, _, _) in enumerate(sorted(SLOTS, key=lambda s: ("3-0", "advance", "0-3").index(s[0])))}
    ticket = sorted(ticket, key=lambda pick: order[pick[0]])
    try:
        best = sims.agg(F.avg((sum(map(on, ticket)) >= needed).cast("double")).alias("p")).first().p or 0.0
        for _ in range(most_swaps):
            taken = {s for _, s in ticket}
            swaps = [(i, new) for i, old in enumerate(ticket) for new in pool if new[0] == old[0] and new[1] not in taken]
            if not swaps:
                break
            base = sims.withColumn("hits", sum(map(on, ticket)))
            found = base.agg(*(F.avg((F.col("hits") - on(ticket[i]) + on(new) >= needed).cast("double")).alias(f"c{k}") for k, (i, new) in enumerate(swaps))).first()
            better = next((k for k, p in enumerate(found) if p is not None and p > best + 1e-12), None)
            if better is None:
                break
            i, new = swaps[better]
            ticket[i], best = new, found[better]
    finally:
        sims.unpersist()
    return ticket, best


def answer_sheet(picks: DataFrame, slots=SLOTS, least_margin: float = 0.04, by: tuple[str, ...] = ()) -> DataFrame:
    """Each category's picks, its least margin and what is wrong with it: slots, repeated teams, narrow or unknown margins."""
    repeated = picks.groupBy(*by, "seed_no").agg(F.count("*").alias("times"))
    want = picks.sparkSession.createDataFrame([(k, n) for k, _, n in slots], "category string, slots long")
    if by:
        wanted = F.array(*(F.struct(F.lit(k).alias("category"), F.lit(n).cast("long").alias("slots")) for k, _, n in slots))
        want = picks.select(*by).distinct().select(*by, F.inline(wanted))
    each = picks.join(repeated, [*by, "seed_no"]).groupBy(*by, "category").agg(F.count("*").alias("picks"), F.sort_array(F.collect_list("seed_no")).alias("_s"), F.min("margin").alias("least_margin"), F.max("times").alias("_t"), F.count_if(F.col("margin").isNull()).alias("_u"))
    n = F.coalesce("picks", F.lit(0))
    faults = F.array(F.when(n != F.col("slots"), "slots"), F.when(F.col("_t") > 1, "repeated"), F.when(F.col("least_margin") < least_margin, "narrow"), F.when(F.col("_u") > 0, "unknown_margin"))
    return want.join(each, [*by, "category"], "left").select(*by, "category", n.alias("picks"), F.array_join("_s", ",").alias("seeds"), "least_margin", F.array_join(F.array_compact(faults), ",").alias("warnings"))
