"""A long-lived match table: keyed upsert, manifest and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def identity():
    """By link if there is one, else by day, pair, map and best-of."""
    return F.coalesce(F.concat(F.lit("url::"), F.lower(F.nullif(F.trim("url"), F.lit("")))), F.concat_ws("::", F.lit("match"), "day", F.least("team1", "team2"), F.greatest("team1", "team2"), "map", "best_of"))


def upsert(rows: DataFrame, batch: str = "batch", seq: str = "seq") -> DataFrame:
    """The last written row of each identity; one aggregation, no sort."""
    last = rows.groupBy(identity().alias("identity")).agg(F.max_by(F.struct(*rows.columns), F.struct(batch, seq)).alias("r"))
    return last.select("identity", "r.*")


def manifest(matches: DataFrame) -> DataFrame:
    teams = matches.select(F.explode(F.array("team1", "team2")).alias("team")).agg(F.count_distinct("team").alias("n_teams"))
    return matches.agg(F.count("*").alias("n_rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).join(F.broadcast(teams))  # one row each


def missing(required: DataFrame, matches: DataFrame) -> DataFrame:
    teams = matches.select(F.explode(F.array("team1", "team2")).alias("team"))
    return required.join(teams, "team", "left_anti")
