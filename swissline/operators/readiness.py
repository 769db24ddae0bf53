"""Readiness gates and tickets: each gate is one aggregate that gives a row (name, passed, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(rows: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    return rows.agg(passed.cast("int").alias("passed"), detail.cast("string").alias("detail")).select(F.lit(name).alias("name"), F.coalesce("passed", F.lit(0)).alias("passed"), "detail")


def audit(matches: DataFrame, minimum_rows: int = 8000, minimum_teams: int = 80, fields: tuple[str, ...] = (), last_day: int | None = None) -> DataFrame:
    """Row count, teams, complete fields, known winners, and how recent the rows are."""
    teams = matches.select(F.explode(F.array("team1", "team2")).alias("team"))
    gates = [
        gate(matches, "rows", F.count("*") >= minimum_rows, F.count("*")),
        gate(teams, "teams", F.count_distinct("team") >= minimum_teams, F.count_distinct("team")),
        gate(matches, "winners", F.count_if(F.col("winner").isNull()) == 0, F.count_if(F.col("winner").isNull())),
        *(gate(matches, f"field_{c}", F.count_if(F.col(c).isNull()) == 0, F.count_if(F.col(c).isNull())) for c in fields),
    ]
    if last_day is not None:
        gates.append(gate(matches, "recent", F.max("day") >= last_day, F.max("day")))
    return reduce(DataFrame.unionByName, gates)


def ticket(shares: DataFrame, slots: tuple[tuple[str, str, int], ...] = (("3-0", "p_30", 2), ("0-3", "p_03", 2), ("advance", "p_advance", 6)), by: tuple[str, ...] = ()) -> DataFrame:
    """Greedy choice, category after category, no team twice. shares: one row a team of a stage; by: the columns that name a stage, if there are several."""
    left, out = shares, []
    for category, column, n in slots:
        best = left.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(column), "seed_no"))).filter(F.col("place") <= n)
        out.append(best.select(*by, F.lit(category).alias("category"), "seed_no", F.col(column).alias("p")))
        left = left.join(best.select(*by, "seed_no"), [*by, "seed_no"], "left_anti")
    return reduce(DataFrame.unionByName, out)


def ticket_faults(picks: DataFrame, teams: DataFrame) -> DataFrame:
    """Teams picked twice and teams that are not in the stage."""
    twice = picks.groupBy("seed_no").agg(F.count("*").alias("n")).filter("n > 1").select("seed_no", F.lit("twice").alias("fault"))
    return twice.unionByName(picks.join(teams, "seed_no", "left_anti").select("seed_no", F.lit("unknown").alias("fault")))


def freshness(manifests: DataFrame, required: DataFrame, now: str, most_hours: int) -> DataFrame:
    """Each source's state: fresh, stale, invalid (no readable time) or missing, and its age in hours. manifests: source, stamp (text)."""
    stamp = F.col("stamp").try_cast("timestamp")
    age = F.round((F.to_timestamp(F.lit(now)).cast("double") - stamp.cast("double")) / 3600, 3)
    known = manifests.select("source", age.alias("age_hours"), F.when(stamp.isNull(), "invalid").when(age <= most_hours, "fresh").otherwise("stale").alias("state"))
    absent = required.join(manifests.select("source"), "source", "left_anti").distinct().select("source", F.lit(None).cast("double").alias("age_hours"), F.lit("missing").alias("state"))
    return known.unionByName(absent)


def coverage(matches: DataFrame, required: DataFrame, minimum_rows: int = 8000, minimum_teams: int = 80) -> DataFrame:
    """Rows and teams so far and still needed, and how many of the required teams are covered."""
    teams = matches.select(F.explode(F.array("team1", "team2")).alias("team")).distinct()
    size = matches.agg(F.count("*").alias("n_rows"))
    met = required.select("team").distinct().join(teams.withColumn("seen", F.lit(1)), "team", "left").agg(F.count("*").alias("required"), F.count("seen").alias("covered"))
    out = size.join(F.broadcast(teams.agg(F.count("*").alias("n_teams")))).join(F.broadcast(met))  # one row each
    return out.withColumns({"rows_remaining": F.greatest(F.lit(0), minimum_rows - F.col("n_rows")).cast("long"), "teams_remaining": F.greatest(F.lit(0), minimum_teams - F.col("n_teams")).cast("long")})
