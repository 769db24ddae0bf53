"""Registered queries of replays: every day of the match view is a case, judged by the twenty days before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swissline.operators import replay
from swissline.plans.catalogue import F_SQL, add, on_forecasts

FEATURES = ["form_diff", "form_confidence"]
DAYS = 20


def scored(f: DataFrame) -> DataFrame:
    return replay.replayed(f, f.withColumn("case_id", F.col("day")), FEATURES, DAYS)


SUMS_SQL = F_SQL + f""", rs AS (SELECT c.day, count(f.match_id)::DOUBLE AS n, coalesce(sum(label), 0)::DOUBLE AS n1, coalesce(sum(form_diff), 0) AS s0, coalesce(sum(form_confidence), 0) AS s1, coalesce(sum(form_diff * label), 0) AS t0, coalesce(sum(form_confidence * label), 0) AS t1,
    coalesce(sum(form_diff * form_diff), 0) AS q0_0, coalesce(sum(form_diff * form_confidence), 0) AS q0_1, coalesce(sum(form_confidence * form_confidence), 0) AS q1_1
  FROM (SELECT DISTINCT day FROM f) c LEFT JOIN f ON f.day < c.day AND f.day >= c.day - {DAYS} GROUP BY c.day)"""
REPLAY_SQL = SUMS_SQL + """, rm AS (SELECT *, t0 / n1 AS u0, t1 / n1 AS u1, (s0 - t0) / (n - n1) AS v0, (s1 - t1) / (n - n1) AS v1 FROM rs),
  rw AS (SELECT *, (q0_0 - n1 * u0 * u0 - (n - n1) * v0 * v0) / n + 1e-6 AS a, (q0_1 - n1 * u0 * u1 - (n - n1) * v0 * v1) / n AS b, (q1_1 - n1 * u1 * u1 - (n - n1) * v1 * v1) / n + 1e-6 AS d FROM rm),
  rc AS (SELECT day, n, n1, CASE WHEN n1 > 0 AND n1 < n THEN (d * (u0 - v0) - b * (u1 - v1)) / (a * d - b * b) ELSE 0 END AS w0, CASE WHEN n1 > 0 AND n1 < n THEN (a * (u1 - v1) - b * (u0 - v0)) / (a * d - b * b) ELSE 0 END AS w1,
    u0 + v0 AS c0, u1 + v1 AS c1 FROM rw),
  rp AS (SELECT match_id, f.day AS case_id, CAST(n AS BIGINT) AS trained, label, 1 / (1 + exp(-(w0 * form_diff + w1 * form_confidence + CASE WHEN n1 > 0 AND n1 < n THEN ln(n1 / (n - n1)) - 0.5 * (c0 * w0 + c1 * w1) ELSE ln((n1 + 0.5) / (n - n1 + 0.5)) END))) AS p FROM f JOIN rc ON rc.day = f.day),
  rr AS (SELECT case_id, max(trained) AS trained, count(*) AS picks, count(CASE WHEN (p >= 0.5) = (label = 1) THEN 1 END) AS hits FROM rp GROUP BY case_id)"""
add("replay_sums", on_forecasts(lambda f: replay.sums_before(replay.daily_sums(f, FEATURES), f, DAYS)), "SELECT * FROM rs", "n n1 s0 s1 t0 t1 q0_0 q0_1 q1_1", SUMS_SQL)
add("replay_probabilities", on_forecasts(lambda f: scored(f).select("case_id", "match_id", "trained", "p")), "SELECT case_id, match_id, trained, p FROM rp", "p", REPLAY_SQL)
add("replay_cases", on_forecasts(lambda f: replay.case_reports(scored(f))), "SELECT *, CAST(hits >= 0.5 * picks AS INT) AS passed FROM rr", "", REPLAY_SQL)
add("replay_suite", on_forecasts(lambda f: replay.suite_report(replay.case_reports(scored(f)))), "SELECT *, CAST(pass_rate >= 0.38 AS INT) AS meets FROM (SELECT count(*) AS cases, count(CASE WHEN hits >= 0.5 * picks THEN 1 END) AS passed, avg((hits >= 0.5 * picks)::INT::DOUBLE) AS pass_rate FROM rr)", "pass_rate", REPLAY_SQL)
