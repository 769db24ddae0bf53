"""Joins of feeds onto matches: keys don't depend on the order of the two teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swissline.functions.keys import map_key


def oriented(df: DataFrame, value: str = "p1") -> DataFrame:
    """lo, hi and the value seen from the lower team."""
    swap = F.col("team1") > F.col("team2")
    return df.withColumns({"lo": F.least("team1", "team2"), "hi": F.greatest("team1", "team2"), "_v": F.when(swap, 1 - F.col(value)).otherwise(F.col(value))})


def merge_odds(matches: DataFrame, odds: DataFrame) -> DataFrame:
    """The mean over providers by match link, else by (day, pair), turned to team1; unmatched rows stay."""
    o = oriented(odds)
    by_link = o.filter("link is not null").groupBy("link").agg(F.avg("_v").alias("_a"))
    by_pair = o.groupBy("day", "lo", "hi").agg(F.avg("_v").alias("_b"))
    m = matches.withColumns({"lo": F.least("team1", "team2"), "hi": F.greatest("team1", "team2")})
    met = m.join(by_link, "link", "left").join(by_pair, ["day", "lo", "hi"], "left")
    p = F.coalesce("_a", "_b")
    return met.select("match_id", F.when(F.col("team1") == F.col("lo"), p).otherwise(1 - p).alias("p1"), F.when(F.col("_a").isNotNull(), "link").when(F.col("_b").isNotNull(), "pair").otherwise("none").alias("basis"))


def merge_last(fixtures: DataFrame, intel: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Left join on the last row of each key."""
    last = intel.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_last"))
    return fixtures.join(last, keys, "left").select(*fixtures.columns, *(F.col(f"_last.{c}").alias(c) for c in columns))


def merge_veto(fixtures: DataFrame, intel: DataFrame, order: str = "seq") -> DataFrame:
    """The last veto row of each (day, pair), its columns turned to the fixture's team1; a known map replaces the fixture's.
    intel: day, team1, team2, map, source, confidence, bans1, bans2 and the order column."""
    fields = {"map": "map", "source": "source", "confidence": "confidence", "bans_a": "bans1", "bans_b": "bans2", "first": "team1"}
    sided = lambda df: df.withColumns({"lo": F.least("team1", "team2"), "hi": F.greatest("team1", "team2")})
    last = sided(intel).groupBy("day", "lo", "hi").agg(F.max_by(F.struct(*(F.col(c).alias(k) for k, c in fields.items())), order).alias("v"))
    met, v = sided(fixtures).join(last, ["day", "lo", "hi"], "left"), lambda c: F.col(f"v.{c}")
    same, named = v("first") == F.col("team1"), map_key(v("map"))
    known = F.when(~named.isin("", "unknown", "tbd", "none"), named)
    turned = {"map": F.coalesce(known, F.col("map")), "veto_applied": F.col("v").isNotNull().cast("int"), "veto_source": v("source"), "veto_confidence": v("confidence"), "bans1": F.when(same, v("bans_a")).otherwise(v("bans_b")), "bans2": F.when(same, v("bans_b")).otherwise(v("bans_a"))}
    return met.withColumns(turned).select(*fixtures.columns, *(c for c in turned if c not in fixtures.columns))


def player_window(long: DataFrame, players: DataFrame, days: int = 15) -> DataFrame:
    """Players of the team with match day - days <= day < match day. Rows are added up by team and day first, so a match meets
    at most ``days`` of them, by an equal join on team and block of days and then the exact range."""
    day = players.groupBy("team", "day").agg(
        F.count("*").alias("n"), F.count("rating").alias("nr"), F.sum("rating").alias("sr"), F.max("rating").alias("star"), F.max("is_sub").alias("sub"), F.max_by("rating", "pid").alias("last")
    )
    p = day.withColumn("_block", F.explode(F.array(F.expr(f"day div {days}"), F.expr(f"day div {days} + 1"))))
    m = long.select("match_id", "side", "team", F.col("day").alias("on"), F.expr(f"day div {days}").alias("_block"))
    met = m.join(p, ["team", "_block"]).filter(f"day < on and day >= on - {days}")
    each = met.groupBy("match_id", "side").agg(
        F.sum("n").alias("n_players"), (F.sum("sr") / F.nullif(F.sum("nr"), F.lit(0))).alias("rating"), F.max("star").alias("star"), F.max("sub").alias("any_sub"), F.max_by("last", "day").alias("last_rating")
    )
    return long.select("match_id", "side").join(each, ["match_id", "side"], "left").fillna({"n_players": 0})


def merge_standings(fixtures: DataFrame, standings: DataFrame) -> DataFrame:
    """Both sides' records of the stage, none played where there is no row; the round is one more than the longer record."""
    side = lambda n: standings.select("stage", F.col("team").alias(f"team{n}"), F.col("wins").alias(f"wins{n}"), F.col("losses").alias(f"losses{n}"))
    met = fixtures.join(side(1), ["stage", "team1"], "left").join(side(2), ["stage", "team2"], "left")
    cells = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("wins1", "losses1", "wins2", "losses2")}
    return met.withColumns(cells).select("match_id", *cells, (1 + F.greatest(F.col("wins1") + F.col("losses1"), F.col("wins2") + F.col("losses2"))).alias("swiss_round"))


def merge_metadata(fixtures: DataFrame, teams: DataFrame, columns: list[str]) -> DataFrame:
    """A team's columns onto both sides where the fixture has none of its own."""
    out = fixtures
    for n in (1, 2):
        out = out.join(teams.select(F.col("team").alias(f"team{n}"), *(F.col(c).alias(f"_{c}{n}") for c in columns)), f"team{n}", "left")
    fill = {f"{c}{n}": F.coalesce(f"{c}{n}", f"_{c}{n}") if f"{c}{n}" in fixtures.columns else F.col(f"_{c}{n}") for c in columns for n in (1, 2)}
    return out.select(*(c for c in fixtures.columns if c not in fill), *(v.alias(k) for k, v in fill.items()))


def pair_means(signals: DataFrame) -> DataFrame:
    """Mean value of each pair, seen from its lower team."""
    return oriented(signals).groupBy("lo", "hi").agg(F.avg("_v").alias("p_lo"), F.count("*").alias("n"))


def market_strength(signals: DataFrame) -> DataFrame:
    """Mean implied probability of each team over both sides."""
    side = F.explode(F.array(F.struct(F.col("team1").alias("team"), F.col("p1").alias("p")), F.struct(F.col("team2").alias("team"), (1 - F.col("p1")).alias("p")))).alias("s")
    return signals.select(side).groupBy("s.team").agg(F.avg("s.p").alias("strength"), F.count("*").alias("n"))


def as_of(matches: DataFrame, versions: DataFrame) -> DataFrame:
    """The latest version at or before each day: one sorted pass over the union by day, no range join."""
    days = matches.select("day").distinct().select("day", F.lit(None).cast("string").alias("tag"), F.lit(1).alias("_o")).unionByName(versions.select("day", "tag", F.lit(0).alias("_o")))
    tagged = days.withColumn("version", F.last("tag", True).over(Window.orderBy("day", "_o").rowsBetween(Window.unboundedPreceding, 0))).filter("_o = 1")
    return matches.join(tagged.select("day", "version"), "day", "left").select("match_id", F.coalesce("version", F.lit("unknown")).alias("version"))


def lookup_unique(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """By (day, pair) where that has one result, else by pair where that has one, else nothing."""
    exact = results.groupBy("day", "lo", "hi").agg(F.count("*").alias("n"), F.max("rid").alias("exact")).filter("n = 1").drop("n")
    loose = results.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.max("rid").alias("loose")).filter("n = 1").drop("n")
    met = wanted.join(exact, ["day", "lo", "hi"], "left").join(loose, ["lo", "hi"], "left")
    return met.select("match_id", F.coalesce("exact", "loose").alias("rid"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "loose").otherwise("none").alias("basis"))


def best_signal(signals: DataFrame) -> DataFrame:
    """For each pair the mean of its signals of the best basis (least priority); proxy only if all are."""
    o = oriented(signals)
    best = o.withColumn("_k", F.rank().over(Window.partitionBy("lo", "hi").orderBy("priority"))).filter("_k = 1")
    return best.groupBy("lo", "hi").agg(F.avg("_v").alias("p_lo"), F.min("priority").cast("long").alias("priority"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"), F.min(F.col("proxy").cast("int")).alias("proxy"))
