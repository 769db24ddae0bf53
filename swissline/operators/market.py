"""Market probabilities: de-vigging, fusion, series and stakes, all as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def devig_multiplicative(o1: Column, o2: Column) -> Column:
    return F.when((o1 > 0) & (o2 > 0), (1 / o1) / (1 / o1 + 1 / o2)).otherwise(F.lit(0.5))


def devig_shin(o1: Column, o2: Column) -> Column:
    """Two outcomes: z closes the overround; where it is not positive the shares are multiplicative."""
    a, b = 1 / o1, 1 / o2
    s, d = a + b, a - b
    z = ((s - 1) * (d * d - s)) / (s * (d * d - 1))
    p = (F.sqrt(z * z + 4 * (1 - z) * a * a / s) - z) / (2 * (1 - z))
    q = (F.sqrt(z * z + 4 * (1 - z) * b * b / s) - z) / (2 * (1 - z))
    return F.when((o1 > 0) & (o2 > 0), F.when((z > 0) & (z < 1), p / (p + q)).otherwise(a / s)).otherwise(F.lit(0.5))


def devig_power(o1: str, o2: str, steps: int = 60) -> Column:
    """k with (1/o1)**k + (1/o2)**k = 1 by ``steps`` halvings of [0, 20]."""
    search = f"""aggregate(sequence(1, {steps}), struct(0D AS lo, 20D AS hi),
        (s, i) -> if(pow(1 / {o1}, (s.lo + s.hi) / 2) + pow(1 / {o2}, (s.lo + s.hi) / 2) > 1, struct((s.lo + s.hi) / 2 AS lo, s.hi AS hi), struct(s.lo AS lo, (s.lo + s.hi) / 2 AS hi)))"""
    k = f"(({search}).lo + ({search}).hi) / 2"
    return F.expr(f"pow(1 / {o1}, {k})")


def logit_pool(p: Column, market: Column, weight: float) -> Column:
    clip = lambda x: F.least(F.greatest(x, F.lit(EPS)), F.lit(1 - EPS))
    logit = lambda x: F.ln(clip(x) / (1 - clip(x)))
    return 1 / (1 + F.exp(-(weight * logit(p) + (1 - weight) * logit(market))))


def legacy_clip(p: Column, market: Column, most: float = 0.03) -> Column:
    return p + F.greatest(F.least(market - p, F.lit(most)), F.lit(-most))


def series_probability(p: Column, best_of: Column) -> Column:
    q = 1 - p
    return (
        F.when(best_of == 1, p).when(best_of == 3, p * p * (1 + 2 * q)).when(best_of == 5, p * p * p * (1 + 3 * q + 6 * q * q))
        .when(best_of == 7, F.pow(p, F.lit(4.0)) * (1 + 4 * q + 10 * q * q + 20 * q * q * q))
    )


def score_distribution(matches: DataFrame, p: str, key: str) -> DataFrame:
    """Score lines of a best of three: (2,0), (2,1), (1,2), (0,2)."""
    q = 1 - F.col(p)
    lines = [("2-0", F.col(p) * F.col(p)), ("2-1", 2 * F.col(p) * F.col(p) * q), ("1-2", 2 * F.col(p) * q * q), ("0-2", q * q)]
    return matches.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("score"), v.alias("probability")) for n, v in lines))).alias("s")).select(key, "s.*")


def kelly(p: Column, odds: Column, fraction: float = 0.5) -> Column:
    return F.when(odds > 1, F.greatest((p * odds - 1) / (odds - 1), F.lit(0.0)) * min(max(fraction, 0.0), 0.5)).otherwise(F.lit(0.0))


def kelly_audit(bets: DataFrame, p: str, odds: Column, key: str, fraction: float = 0.5) -> DataFrame:
    """Why a stake has its size: edge for each unit, full and fractional Kelly."""
    raw, part = kelly(F.col(p), F.col("odds"), 0.5) / 0.5, F.lit(min(max(fraction, 0.0), 0.5))
    edge = (F.col("odds") - 1) * F.col(p) - (1 - F.col(p))
    return bets.withColumn("odds", odds).select(key, p, "odds", edge.alias("edge"), raw.alias("raw_kelly"), part.alias("fraction"), (part * raw).alias("fractional_kelly"))


def linear_blend(p: Column, market: Column, weight: float) -> Column:
    return F.least(F.greatest((1 - weight) * p + weight * market, F.lit(EPS)), F.lit(1 - EPS))


def exposure_cap(stakes: DataFrame, stake: str, most: float, *keys: str) -> DataFrame:
    total = F.sum(stake).over(Window.partitionBy(*keys))
    return stakes.withColumn("capped", F.when(total > most, F.col(stake) * most / total).otherwise(F.col(stake)))


def map_probability(p: str, best_of: int, steps: int = 60) -> Column:
    """The map probability whose series probability is ``p``, by ``steps`` halvings of [0, 1]."""
    series = {1: "{x}", 3: "{x} * {x} * (3 - 2 * {x})", 5: "pow({x}, 3) * (10 - 15 * {x} + 6 * {x} * {x})", 7: "pow({x}, 4) * (35 - 84 * {x} + 70 * {x} * {x} - 20 * pow({x}, 3))"}[best_of].replace("{x}", "((s.lo + s.hi) / 2)")
    search = f"aggregate(sequence(1, {steps}), struct(0D AS lo, 1D AS hi), (s, i) -> if({series} < {p}, struct((s.lo + s.hi) / 2 AS lo, s.hi AS hi), struct(s.lo AS lo, (s.lo + s.hi) / 2 AS hi)), s -> (s.lo + s.hi) / 2)"
    return F.expr(search)


def _pool_scores(profiles: DataFrame, fixtures: DataFrame, pool: list[str]) -> DataFrame:
    """A row for each fixture and map of the pool that no side bans; a map without history has win rate 0.5 and no preference."""
    side = lambda n: profiles.select(F.col("team").alias(f"team{n}"), "map", *(F.col(c).alias(f"{c}{n}") for c in ("winrate", "preferred", "banned")))
    met = fixtures.withColumn("map", F.explode(F.array(*map(F.lit, pool)))).join(side(1), ["team1", "map"], "left").join(side(2), ["team2", "map"], "left")
    met = met.fillna({"winrate1": 0.5, "winrate2": 0.5, "preferred1": 0, "preferred2": 0, "banned1": 0, "banned2": 0}).filter("banned1 = 0 and banned2 = 0")
    likely = F.col("preferred1") + F.col("preferred2") + 1 - F.least(F.lit(1.0), F.abs(F.col("winrate1") - F.col("winrate2")))
    return met.withColumns({"likely": likely, "score": F.round(likely + (F.col("winrate1") + F.col("winrate2")) / 2, 9)})


def candidate_maps(profiles: DataFrame, fixtures: DataFrame, pool: list[str], top: int = 3) -> DataFrame:
    """The maps that may be played, by preferences, balance and strength, then name, and the weight of each among them.
    profiles: team, map, winrate, preferred (points), banned; fixtures: match_id, team1, team2."""
    w = Window.partitionBy("match_id").orderBy(F.desc("score"), "map")
    best = _pool_scores(profiles, fixtures, pool).withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= top)
    all_of = Window.partitionBy("match_id")
    total = F.sum("likely").over(all_of)
    return best.select("match_id", "place", "map", F.when(total > 0, F.col("likely") / total).otherwise(1 / F.count("*").over(all_of)).alias("weight"))


def unknown_map_average(candidates: DataFrame, forecasts: DataFrame, weighted: bool = False) -> DataFrame:
    """The mean forecast over a fixture's candidate maps, plain or by weight. forecasts: match_id, map, p."""
    p = F.sum(F.col("p") * F.col("weight")) / F.sum("weight") if weighted else F.avg("p")
    return candidates.join(forecasts, ["match_id", "map"]).groupBy("match_id").agg(p.alias("p"), F.count("*").alias("n_maps"))
