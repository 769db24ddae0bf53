"""Registered queries over the feature table, ratings of fixtures, fusion and choice of candidates, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swissline.operators import cleaning, fusion, match_features, serving, swiss, tuning
from swissline.plans.catalogue import F_SQL, LONG_SQL, LOSS, MATCH_SQL, PICK_SQL, POOL, STAGE_SQL, STATE, add, in_stages, on_forecasts, on_matches, stage_picks
from swissline.sources.matches import long_form

# ---------------------------------------------------------------- the feature table
#: Some of the table's inputs; nulls, blanks and absent columns among them.
INPUTS = (
    "match_id", "day", "team1", "team2", "concat('de_', map) as map", "best_of", "tier as event_tier", "if(match_id % 5 = 0, null, 1 + match_id % 60) as team1_rank", "1 + team2 % 70 as team2_rank",
    "1500 + v1 as team1_elo", "if(match_id % 4 = 0, ' ', cast(1500 + v2 as string)) as team2_elo", "v1 / 100 as team1_recent_winrate_5", "odds1 as odds_team1", "odds2 as odds_team2",
    "match_id % 4 as team1_wins", "match_id % 3 as team2_wins", "(match_id div 5) % 3 as team1_losses", "(match_id div 7) % 3 as team2_losses", "1 + match_id % 5 as swiss_round",
    "match_id % 2 = 0 as veto_applied", "0.5D as veto_confidence", "array('click', 'view') as bans1", "array(map) as bans2", "array('train') as picks1",
    "1500 + v1 as team1_glicko_pre", "1500 + v2 as team2_glicko_pre", "if(match_id % 2 = 0, 350D, null) as team1_rd_pre", "100D as team2_rd_pre", "element_at(array('no', 'yes', null), cast(match_id % 3 + 1 as int)) as market_signal_proxy",
)
NEUTRAL = ("rmr_points_diff major_best_placement_diff matches_30d_diff recent_winrate_10_diff bo1_winrate_diff bo3_winrate_diff map_winrate_diff rating_diff kd_diff opening_success_diff clutch_winrate_diff star_rating_diff "
           "substitute_flag_diff player_sample_diff player_form_score_diff player_form_trend_diff player_sample_confidence_diff current_streak_diff bt_strength_diff bt_map_strength_diff odds_provider_count "
           "event_grade_sum team_event_grade_sum team_event_grade_diff odds_overround odds_devig_z event_code version_tag_code").split()
FEATURE_SQL = LONG_SQL + """, tc AS (SELECT team, row_number() OVER (ORDER BY k) - 1 AS code FROM (SELECT team, min(row(day, match_id, side)) AS k FROM l GROUP BY team)),
  ec AS (SELECT tier, row_number() OVER (ORDER BY k) - 1 AS code FROM (SELECT tier, min(row(day, match_id)) AS k FROM m GROUP BY tier)),
  x AS (SELECT *, match_id % 4 AS w1, match_id % 3 AS w2, (match_id // 5) % 3 AS l1, (match_id // 7) % 3 AS l2, match_id % 2 = 0 AS veto FROM m)"""
FEATURES = {
    "rank_diff": "1 + team2 % 70 - CASE WHEN match_id % 5 = 0 THEN 80 ELSE 1 + match_id % 60 END", "elo_diff": "v1 - CASE WHEN match_id % 4 = 0 THEN 0 ELSE v2 END", "recent_winrate_5_diff": "v1 / 100 - 0.5",
    "h2h_team1_winrate": "0.5", "odds_implied_diff": "(1 / odds1 - 1 / odds2) / (1 / odds1 + 1 / odds2)", "glicko_diff": "v1 - v2", "glicko_rd_sum": "CASE WHEN veto THEN 450 ELSE 700 END",
    "bp_applied": "veto::INT", "bp_confidence": "CASE WHEN veto THEN 0.5 ELSE 0 END", "bp_total_bans": "CASE WHEN veto THEN 3 ELSE 0 END", "bp_ban_overlap": "(veto AND map IN ('click', 'view'))::INT", "bp_total_picks": "veto::INT",
    "odds_is_proxy": "(match_id % 3 = 1)::INT", "is_bo1": "(best_of = 1)::INT", "is_bo3": "(best_of = 3)::INT", "swiss_round": "1 + match_id % 5", "team1_wins": "w1", "team1_losses": "l1", "team2_wins": "w2", "team2_losses": "l2",
    "swiss_score_diff": "w1 - l1 - w2 + l2", "wins_needed_to_advance_diff": "w1 - w2", "losses_until_elimination_diff": "l2 - l1", "team1_code": "a.code", "team2_code": "b.code", "event_tier_code": "ec.code",
    **{f"map_{g}": f"(map = '{g}')::INT" for g in POOL}, **dict.fromkeys(NEUTRAL, "0"),
}
add("match_features", on_matches(lambda m: match_features.match_features(m.selectExpr(*INPUTS), unverified=True, maps=tuple(POOL))), f"""
    SELECT match_id, {", ".join(f"({x})::DOUBLE AS {f}" for f, x in FEATURES.items())} FROM x JOIN tc a ON a.team = team1 JOIN tc b ON b.team = team2 JOIN ec USING (tier)""", " ".join(FEATURES), FEATURE_SQL)
add("rows_in_dates", on_matches(lambda m: cleaning.in_dates(m.selectExpr("match_id", "case match_id % 7 when 0 then 'soon' when 1 then null else cast(date_from_unix_date(cast(day as int)) as string) end as date"), "date", "2024-01-10", "2024-01-20").select("match_id")),
    "SELECT match_id FROM m WHERE match_id % 7 > 1 AND day BETWEEN 19732 AND 19742", "", MATCH_SQL)


# ---------------------------------------------------------------- ratings of fixtures
def _strengths(m: DataFrame, *by: str) -> DataFrame:
    return long_form(m).groupBy(*by, "team").agg(F.avg("v").alias("theta"))


add("fixture_strengths", on_matches(lambda m: serving.with_strengths(m.selectExpr("match_id", "team1", "team2", "map", "if(match_id % 6 = 0, 7D, null) as theta1"), _strengths(m).filter("team % 4 > 0"), _strengths(m, "map").filter("team % 3 > 0")).drop("team1", "team2", "map")), """
    SELECT *, theta1 - theta2 AS theta_diff, map_theta1 - map_theta2 AS map_theta_diff FROM (SELECT match_id, CASE WHEN match_id % 6 = 0 THEN 7 ELSE coalesce(a.v, 0) END AS theta1, coalesce(b.v, 0) AS theta2,
      coalesce(c.v, CASE WHEN match_id % 6 = 0 THEN 7 ELSE coalesce(a.v, 0) END) AS map_theta1, coalesce(d.v, b.v, 0) AS map_theta2
      FROM m LEFT JOIN s a ON a.team = team1 LEFT JOIN s b ON b.team = team2 LEFT JOIN g c ON c.team = team1 AND c.map = m.map LEFT JOIN g d ON d.team = team2 AND d.map = m.map)""", "theta1 theta2 map_theta1 map_theta2 theta_diff map_theta_diff",
    LONG_SQL + ", s AS (SELECT team, avg(v) AS v FROM l WHERE team % 4 > 0 GROUP BY team), g AS (SELECT map, team, avg(v) AS v FROM l WHERE team % 3 > 0 GROUP BY map, team)")
add("fixture_glicko", on_matches(lambda m: serving.with_glicko(m.selectExpr("match_id", "team1", "team2", "if(match_id % 6 = 0, 90D, null) as rd2"), _strengths(m).filter("team % 4 > 0").selectExpr("team", "1500 + theta as mu", "100D as rd")).drop("team1", "team2")), """
    SELECT *, mu1 - mu2 AS mu_diff, rd1 + rd2 AS rd_sum FROM (SELECT match_id, 1500 + coalesce(a.v, 0) AS mu1, 1500 + coalesce(b.v, 0) AS mu2, CASE WHEN a.v IS NULL THEN 350.0::DOUBLE ELSE 100 END AS rd1,
      CASE WHEN match_id % 6 = 0 THEN 90.0::DOUBLE WHEN b.v IS NULL THEN 350 ELSE 100 END AS rd2 FROM m LEFT JOIN s a ON a.team = team1 LEFT JOIN s b ON b.team = team2)""", "mu1 mu2 rd1 rd2 mu_diff rd_sum",
    LONG_SQL + ", s AS (SELECT team, avg(v) AS v FROM l WHERE team % 4 > 0 GROUP BY team)")

# ---------------------------------------------------------------- fusion
def _candidates(m: DataFrame) -> DataFrame:
    each = swiss.standings(in_stages(m), "stage").withColumn("category", F.explode(F.array(*map(F.lit, ("3-0", "advance", "0-3")))))
    return each.selectExpr("stage", "team", "category", "((team * 13 + stage) % 17) / 16D as market", "((team * 11 + stage + length(category)) % 19) / 19D as model", "if(team % 8 = 0, null, ((team * 3) % 10) / 10D) as confidence", "cast(team % 6 = 0 as int) as substitute")


def _ballots(m: DataFrame) -> DataFrame:
    """Ten ballots for each stage."""
    each = swiss.standings(in_stages(m), "stage").withColumn("ballot", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return each.selectExpr("stage", "team", "ballot", "element_at(array('3-0', '0-3', 'advance', 'advance', null), cast((team * 7 + ballot * 3 + stage) % 5 + 1 as int)) as category").filter("category is not null")


BALLOT_SQL = STAGE_SQL + """, b AS (SELECT stage, team, i, ['3-0', '0-3', 'advance', 'advance', NULL][(team * 7 + i * 3 + stage) % 5 + 1] AS category FROM st, range(10) t(i)),
  n AS (SELECT stage, count(DISTINCT i) AS n FROM b WHERE category IS NOT NULL GROUP BY stage),
  vs AS (SELECT stage, team, c, count(*) / max(n)::DOUBLE AS experts FROM b JOIN n USING (stage), (SELECT unnest(['3-0', 'advance', '0-3']) AS c) WHERE category = c OR category = '3-0' AND c = 'advance' GROUP BY ALL),
  ca AS (SELECT st.stage, st.team, category, ((st.team * 13 + st.stage) % 17) / 16.0::DOUBLE AS market, ((st.team * 11 + st.stage + length(category)) % 19) / 19.0::DOUBLE AS model,
    CASE WHEN st.team % 8 > 0 THEN 1 - ((st.team * 3) % 10) / 10.0::DOUBLE END AS few, (st.team % 6 = 0)::INT AS sub, coalesce(experts, 0) AS experts FROM st CROSS JOIN (SELECT unnest(['3-0', 'advance', '0-3']) AS category) LEFT JOIN vs ON vs.stage = st.stage AND vs.team = st.team AND c = category),
  sc AS (SELECT *, CASE WHEN category = '0-3' THEN 1 - market ELSE market END AS up, rank() OVER (PARTITION BY stage, category ORDER BY model DESC) <= 4 AS high FROM ca),
  fs AS (SELECT *, (0.3 * coalesce((experts - min(experts) OVER w) / nullif(max(experts) OVER w - min(experts) OVER w, 0), 0.5) + 0.2 * coalesce((up - min(up) OVER w) / nullif(max(up) OVER w - min(up) OVER w, 0), 0.5)
    + 0.5 * coalesce((model - min(model) OVER w) / nullif(max(model) OVER w - min(model) OVER w, 0), 0.5)) * CASE WHEN few IS NULL THEN 1 WHEN category = '0-3' THEN least(1.08, 1 + few * 0.04 + sub * 0.03) WHEN category = '3-0' THEN greatest(0.84, 1 - few * 0.12 - sub * 0.08) ELSE greatest(0.9, 1 - few * 0.05 - sub * 0.04) END AS score,
    CASE category WHEN '3-0' THEN (experts >= 0.2)::INT + (market >= 0.55)::INT + high::INT WHEN '0-3' THEN (experts >= 0.2)::INT + (market <= 0.45)::INT + high::INT ELSE (experts >= 0.5)::INT + (market >= 0.5)::INT + (model >= 0.55)::INT END AS agreeing FROM sc WINDOW w AS (PARTITION BY stage, category))"""
add("vote_fusion", on_matches(lambda m: fusion.fused(_candidates(m), fusion.vote_shares(_ballots(m), "stage"), "stage").select("stage", "team", "category", "experts", "score", "agreeing", "tier", "margin", "swing")), """
    SELECT *, coalesce(margin < 0.04, false)::INT AS swing FROM (SELECT stage, team, category, experts, score, agreeing, ['Low', 'Low', 'Medium', 'High'][agreeing + 1] AS tier, score - lead(score) OVER (PARTITION BY stage, category ORDER BY score DESC, team) AS margin FROM fs)""", "experts score margin", BALLOT_SQL)
add("scoreboard_diagnostics", on_matches(lambda m: fusion.scoreboard(stage_picks(m).withColumn("state", swiss.checkpoint()).selectExpr("stage", "team", "category", "state", "(team + stage) % 3 = 0 as selected", "(team * 7 + stage) % 11 + 1 as adjusted_rank"), "stage")), f"""
    SELECT stage, category, count(*) AS candidates, count_if(s) AS selected, count_if(s AND state = 'locked') AS selected_locked, count_if(s AND state = 'broken') AS selected_broken, count_if(NOT s AND state = 'locked') AS missed,
      min(CASE WHEN NOT s AND state = 'locked' THEN (team * 7 + stage) % 11 + 1 END) AS best_missed_rank, coalesce(string_agg(CASE WHEN NOT s AND state = 'locked' THEN CAST(team AS VARCHAR) END, ',' ORDER BY team), '') AS missed_teams,
      count_if(state = 'locked') AS locked, count_if(state = 'alive') AS alive, count_if(state = 'broken') AS broken, count_if(state = 'missing') AS missing FROM (SELECT *, {STATE} AS state, (team + stage) % 3 = 0 AS s FROM k) GROUP BY stage, category""", "", PICK_SQL)
add("market_adjustments", on_matches(lambda m: fusion.market_adjustments(m.selectExpr("element_at(array('odds', 'poll', null), cast(match_id % 3 + 1 as int)) as basis", "match_id % 4 = 0 as proxy", "match_id % 5 < 2 as applied", "if(match_id % 7 = 0, null, tier) as source"))), """
    SELECT 'cached' AS measure, '' AS name, count(*) AS n FROM q0 UNION ALL SELECT CASE WHEN applied THEN 'adjusted' ELSE 'unadjusted' END, '', count(*) FROM q0 GROUP BY applied UNION ALL SELECT 'signal', '', count(*) FROM q0 WHERE basis IS NOT NULL
    UNION ALL SELECT 'proxy_signal', '', count(*) FROM q0 WHERE basis IS NOT NULL AND match_id % 4 = 0 UNION ALL SELECT 'adjusted_by', coalesce(source, 'unknown'), count(*) FROM q0 WHERE applied GROUP BY source UNION ALL SELECT 'signal_by', basis, count(*) FROM q0 WHERE basis IS NOT NULL GROUP BY basis""", "",
    MATCH_SQL + ", q0 AS (SELECT match_id, ['odds', 'poll', NULL][match_id % 3 + 1] AS basis, match_id % 5 < 2 AS applied, CASE WHEN match_id % 7 > 0 THEN tier END AS source FROM m)")

# ---------------------------------------------------------------- candidates
add("rolling_summary", on_forecasts(lambda f: tuning.rolling_summary(f.withColumn("fold", F.col("match_id") % 5))), f"""
    SELECT count(*) AS folds, avg(a) AS accuracy, avg(b) AS log_loss, avg(c) AS brier, min(a) AS worst_accuracy, max(b) AS worst_log_loss FROM (SELECT avg(CAST((p >= 0.5) = (label = 1) AS DOUBLE)) AS a, avg({LOSS}) AS b, avg(pow(p - label, 2)) AS c FROM f GROUP BY match_id % 5)""",
    "accuracy log_loss brier worst_accuracy worst_log_loss", F_SQL)
add("candidate_choice", on_forecasts(lambda f: tuning.candidate_choice(f.withColumn("part", F.when(F.col("match_id") % 3 == 0, "validation").otherwise("test")), ["p", "market", "p2"])), f"""
    SELECT candidate, validation, test, (row_number() OVER (ORDER BY validation, candidate) = 1)::INT AS chosen, (row_number() OVER (ORDER BY test, candidate) = 1)::INT AS test_best FROM (
      SELECT candidate, avg(CASE WHEN match_id % 3 = 0 THEN {LOSS} END) AS validation, avg(CASE WHEN match_id % 3 > 0 THEN {LOSS} END) AS test FROM (
        SELECT match_id, label, 'p' AS candidate, p FROM f UNION ALL SELECT match_id, label, 'market', market FROM f UNION ALL SELECT match_id, label, 'p2', p2 FROM f) GROUP BY candidate)""", "validation test", F_SQL)
