"""Match history read from the driver's tables, and its long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def match_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a match: events 2k and 2k + 1 are its two sides. One shuffle on the match number."""
    e = read(spark, sf_dir, "events").select(F.expr("event_id div 2").alias("match_id"), (F.col("event_id") % 2).alias("side"), "ts", "user_id", "event_type", "value")
    a, b = F.col("side") == 0, F.col("side") == 1
    of = lambda c, side: F.max(F.when(side, F.col(c)))
    m = e.groupBy("match_id").agg(
        of("ts", a).alias("ts"), of("user_id", a).alias("team1"), of("user_id", b).alias("team2"), of("event_type", a).alias("map"), of("value", a).alias("v1"), of("value", b).alias("v2")
    )
    return m.filter("team1 is not null and team2 is not null and team1 <> team2").selectExpr(
        "match_id", "cast(datediff(cast(ts as date), date'1970-01-01') as bigint) as day", "team1", "team2", "map", "v1", "v2",
        "case when v1 >= v2 then team1 else team2 end as winner",
        "cast(case when match_id % 2 = 0 then 1 else 3 end as bigint) as best_of",
        "element_at(array('S', 'A', 'B', 'C'), cast(match_id % 4 + 1 as int)) as tier",
        "case when match_id % 17 = 0 then 'forfeit' else 'completed' end as status",
        "1.05D + v2 / 100D as odds1", "1.05D + v1 / 100D as odds2",
        "cast(floor(v1) as bigint) as score1", "cast(floor(v2) as bigint) as score2",
    )


#: The same view for the oracle.
MATCH_SQL = """m AS (
  SELECT a.event_id // 2 AS match_id, CAST(date_diff('day', DATE '1970-01-01', CAST(a.ts AS DATE)) AS BIGINT) AS day,
    a.user_id AS team1, b.user_id AS team2, a.event_type AS map, a.value AS v1, b.value AS v2,
    CASE WHEN a.value >= b.value THEN a.user_id ELSE b.user_id END AS winner,
    CAST(CASE WHEN (a.event_id // 2) % 2 = 0 THEN 1 ELSE 3 END AS BIGINT) AS best_of,
    CASE (a.event_id // 2) % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS tier,
    CASE WHEN (a.event_id // 2) % 17 = 0 THEN 'forfeit' ELSE 'completed' END AS status,
    1.05 + b.value / 100 AS odds1, 1.05 + a.value / 100 AS odds2,
    CAST(floor(a.value) AS BIGINT) AS score1, CAST(floor(b.value) AS BIGINT) AS score2
  FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0 AND a.user_id <> b.user_id)"""
LONG_SQL = MATCH_SQL + """, l AS (
  SELECT match_id, day, 1 AS side, team1 AS team, team2 AS opp, CAST(winner = team1 AS DOUBLE) AS won, map, best_of, v1 AS v FROM m UNION ALL
  SELECT match_id, day, 2, team2, team1, CAST(winner = team2 AS DOUBLE), map, best_of, v2 FROM m)"""


def long_form(matches: DataFrame) -> DataFrame:
    """Two rows a match: team, opponent, and won as a double; an unknown winner counts as lost for both."""
    side = lambda n, t, o, v: F.struct(F.lit(n).alias("side"), F.col(t).alias("team"), F.col(o).alias("opp"), F.coalesce(F.col("winner") == F.col(t), F.lit(False)).cast("double").alias("won"), F.col(v).alias("v"))
    return matches.select("match_id", "day", "map", "best_of", F.explode(F.array(side(1, "team1", "team2", "v1"), side(2, "team2", "team1", "v2"))).alias("s")).select("match_id", "day", "s.*", "map", "best_of")
