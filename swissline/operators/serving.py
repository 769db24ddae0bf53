"""Ratings of upcoming matches from what is known of the teams at the end of the history; columns that are filled already stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swissline.functions import keys


def _looked_up(rows: DataFrame, table: DataFrame, on: dict[str, str], value: str, out: str, neutral: Column) -> DataFrame:
    """``out`` where it is there, else ``value`` of the table's row (its key columns: those of the rows), else ``neutral``."""
    own = F.col(out).cast("double") if out in rows.columns else F.lit(None).cast("double")
    found = table.select(*(F.col(k).alias(c) for k, c in on.items()), F.col(value).alias("_found"))
    return rows.withColumn("_own", own).drop(out).join(found, list(on.values()), "left").withColumn(out, F.coalesce(F.col("_own"), F.col("_found"), neutral)).drop("_own", "_found")


def with_strengths(fixtures: DataFrame, strengths: DataFrame, by_map: DataFrame | None = None) -> DataFrame:
    """Bradley-Terry strengths (team, theta) of both teams, and those on the map (map, team, theta), which fall back to the former; unknown teams are 0."""
    out = fixtures.withColumn("_map", keys.map_key(F.col("map")))
    for n in (1, 2):
        out = _looked_up(out, strengths, {"team": f"team{n}"}, "theta", f"theta{n}", F.lit(0.0))
    none = strengths.limit(0).withColumn("map", F.lit(""))
    maps = none if by_map is None else by_map.withColumn("map", keys.map_key(F.col("map")))
    for n in (1, 2):
        out = _looked_up(out, maps, {"map": "_map", "team": f"team{n}"}, "theta", f"map_theta{n}", F.col(f"theta{n}"))
    return out.drop("_map").withColumns({"theta_diff": F.col("theta1") - F.col("theta2"), "map_theta_diff": F.col("map_theta1") - F.col("map_theta2")})


def with_glicko(fixtures: DataFrame, state: DataFrame, mu: float = 1500.0, rd: float = 350.0) -> DataFrame:
    """Ratings and deviations (team, mu, rd) of both teams, their difference and sum; unknown teams get the start values."""
    out = fixtures
    for n in (1, 2):
        out = _looked_up(out, state, {"team": f"team{n}"}, "mu", f"mu{n}", F.lit(mu))
        out = _looked_up(out, state, {"team": f"team{n}"}, "rd", f"rd{n}", F.lit(rd))
    return out.withColumns({"mu_diff": F.col("mu1") - F.col("mu2"), "rd_sum": F.col("rd1") + F.col("rd2")})
