"""Leakage-free form of teams before each match, as window functions ordered by (day, match_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _prior(*keys: str, rows: int | None = None):
    w = Window.partitionBy(*keys).orderBy("day", "match_id")
    return w.rowsBetween(-rows if rows else Window.unboundedPreceding, -1)


def _avg(c: str, w, default: float = 0.5) -> Column:
    return F.coalesce(F.avg(c).over(w), F.lit(float(default)))


def recent_winrate(long: DataFrame, last: int) -> DataFrame:
    return long.select("match_id", "side", "team", _avg("won", _prior("team", rows=last)).alias("winrate"))


def matches_since(long: DataFrame, days: int = 30) -> DataFrame:
    """Matches of the last days; earlier rows of the same day count, this and later rows don't."""
    in_range = Window.partitionBy("team").orderBy("day").rangeBetween(-days, 0)
    today = Window.partitionBy("team", "day").orderBy(F.desc("match_id"))
    return long.select("match_id", "side", "team", (F.count("*").over(in_range) - F.row_number().over(today)).cast("long").alias("n_matches"))


def mode_winrate(long: DataFrame, days: int = 182) -> DataFrame:
    in_range = Window.partitionBy("team", "best_of").orderBy("day").rangeBetween(-days, 0)
    today = Window.partitionBy("team", "best_of", "day").orderBy(F.desc("match_id")).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(in_range) - F.count("*").over(today)
    won = F.sum("won").over(in_range) - F.sum("won").over(today)
    return long.select("match_id", "side", "team", F.when(n > 0, won / n).otherwise(F.lit(0.5)).alias("winrate"))


def map_winrate(long: DataFrame) -> DataFrame:
    return long.select("match_id", "side", "team", _avg("won", _prior("team", "map")).alias("winrate"))


def streak(long: DataFrame) -> DataFrame:
    """Signed length of the current run of wins or losses before the match."""
    by_team, by_run = Window.partitionBy("team").orderBy("day", "match_id"), Window.partitionBy("team", "won").orderBy("day", "match_id")
    islands = long.withColumn("island", F.row_number().over(by_team) - F.row_number().over(by_run))
    inside = Window.partitionBy("team", "won", "island").orderBy("day", "match_id")
    signed = islands.withColumn("run", F.row_number().over(inside) * F.when(F.col("won") > 0, 1).otherwise(-1))
    return signed.select("match_id", "side", "team", F.coalesce(F.lag("run").over(by_team), F.lit(0)).cast("long").alias("streak"))


def h2h(matches: DataFrame, last: int = 3) -> DataFrame:
    """team1's share of the last meetings of the two; meetings without a winner stay in the denominator."""
    paired = matches.withColumns({"lo": F.least("team1", "team2"), "hi": F.greatest("team1", "team2")})
    w = _prior("lo", "hi", rows=last)
    low = F.sum(F.coalesce(F.col("winner") == F.col("lo"), F.lit(False)).cast("double")).over(w)
    high = F.sum(F.coalesce(F.col("winner") == F.col("hi"), F.lit(False)).cast("double")).over(w)
    n = F.count("*").over(w)
    return paired.select("match_id", F.when(n > 0, F.when(F.col("team1") == F.col("lo"), low).otherwise(high) / n).otherwise(F.lit(0.5)).alias("h2h"))


def fill_from_history(long: DataFrame, value: str, default: float) -> DataFrame:
    return long.select("match_id", "side", "team", F.coalesce(F.col(value), F.avg(value).over(_prior("team")), F.lit(float(default))).alias("filled"))


def decayed_winrate(long: DataFrame, half_life: float = 90.0, pseudocount: float = 0.0, origin: int = 19_000) -> DataFrame:
    """Weights 2 ** (-age / half_life); the match's own day cancels out of the ratio but for the prior."""
    weight = F.pow(F.lit(2.0), (F.col("day") - origin) / half_life)
    own = F.pow(F.lit(2.0), (F.col("day") - origin) / half_life)
    w = _prior("team")
    won, total = F.sum(F.col("won") * weight).over(w) / own, F.sum(weight).over(w) / own
    return long.select("match_id", "side", "team", F.coalesce((won + 0.5 * pseudocount) / F.nullif(total + pseudocount, F.lit(0.0)), F.lit(0.5)).alias("winrate"))


def opponent_weight(elo: Column, scale: float = 400.0) -> Column:
    return 2 / (1 + F.exp(-(elo - 1500.0) / scale))


def team_profile(long: DataFrame) -> DataFrame:
    """Over the whole history: each map's matches and win rate, 3, 2, 1 points for the most played (ties: first seen), the three least played by (n, map) banned."""
    by_map = long.groupBy("team", "map").agg(F.count("*").alias("n"), F.avg("won").alias("winrate"), F.min(F.struct("day", "match_id")).alias("seen"))
    most, least = Window.partitionBy("team").orderBy(F.desc("n"), "seen"), Window.partitionBy("team").orderBy("n", "map")
    return by_map.select("team", "map", F.col("n").cast("long").alias("n"), "winrate", F.greatest(4 - F.row_number().over(most), F.lit(0)).cast("int").alias("preferred"), (F.row_number().over(least) <= 3).cast("int").alias("banned"))


def opponent_winrate(long: DataFrame, elo: DataFrame, limit: int = 10, pseudocount: float = 0.0) -> DataFrame:
    """Win rate of the last matches, each weighted by the opponent's rating before it. elo: match_id, elo1, elo2."""
    met = long.join(elo, "match_id").withColumn("_w", opponent_weight(F.when(F.col("side") == 1, F.col("elo2")).otherwise(F.col("elo1"))))
    last = Window.partitionBy("team").orderBy("day", "match_id").rowsBetween(-limit, -1)
    won, total = F.sum(F.col("won") * F.col("_w")).over(last), F.sum("_w").over(last)
    return met.select("match_id", "side", "team", F.coalesce((won + 0.5 * pseudocount) / F.nullif(total + pseudocount, F.lit(0.0)), F.lit(0.5)).alias("winrate"))
