"""Registered queries of trees: thresholds with their SQL, and probabilities of the last days from trees fitted on the days before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swissline.operators import trees
from swissline.plans.catalogue import F_SQL, MATCH_SQL, add, on_forecasts, on_matches

COLUMNS = ["p", "market", "form_diff", "form_confidence"]


def _later(fit):
    """Probabilities of the last fifth of days by a model of the days before."""

    def run(f: DataFrame) -> DataFrame:
        cut = f.agg(F.percentile("day", F.lit(0.8))).first()[0]
        model = fit(f.filter(F.col("day") <= cut))
        return trees.with_probability(f.filter(F.col("day") > cut).select("match_id", *COLUMNS), model, "p_tree").select("match_id", "p_tree")

    return run


def _thresholds(columns: list[str]):
    return lambda rows: trees.thresholds(rows, columns).withColumn("feature", F.element_at(F.array(*map(F.lit, columns)), F.col("feature") + 1)).withColumn("place", F.col("place").cast("long"))


def thresholds_sql(columns: list[str], table: str) -> str:
    values = " UNION ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value FROM {table} WHERE {c} IS NOT NULL" for c in columns)
    return f"""SELECT feature, place, (value + nxt) / 2 AS threshold FROM (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY feature) AS n, lead(value) OVER w AS nxt FROM ({values}) WINDOW w AS (PARTITION BY feature ORDER BY value))
      JOIN (SELECT unnest(range(16)) AS place) ON k = CASE WHEN n - 1 <= 16 THEN place ELSE CAST(round_even(place * (n - 2) / 15.0::DOUBLE, 0) AS BIGINT) END WHERE nxt IS NOT NULL"""


add("split_thresholds", on_matches(_thresholds(["v1", "odds1", "best_of", "score1"])), thresholds_sql(["v1", "odds1", "best_of", "score1"], "m"), "threshold", MATCH_SQL)
add("forecast_thresholds", on_forecasts(_thresholds(COLUMNS)), thresholds_sql(COLUMNS, "f"), "threshold", F_SQL)
add("forest_probabilities", on_forecasts(_later(lambda rows: trees.fit_forest(rows, COLUMNS, "match_id"))))
add("boosting_probabilities", on_forecasts(_later(lambda rows: trees.fit_boosting(rows, COLUMNS, "match_id", rounds=8, depth=3))))
