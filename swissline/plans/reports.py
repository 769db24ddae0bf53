"""Registered queries over policies, tickets, pages and further joins, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swissline.operators import evaluate, form, joins, market, model, policies, ratings, readiness, splits, swiss, tickets
from swissline.plans.catalogue import F_SQL, LONG_SQL, LOSS, MATCH_SQL, PICK_SQL, POOL, STAGE_SQL, STATE, add, in_stages, on_forecasts, on_matches, stage_picks
from swissline.sources import pages, results_api, team_pages
from swissline.sources.matches import long_form, match_view, read

# ---------------------------------------------------------------- policies
R_SQL = F_SQL + """, r AS (SELECT *, CAST(match_id % 9 = 0 AS INT) AS substitute, (p >= 0.5) = (label = 1) AS hit, abs(p - 0.5) AS gap, abs(p - 0.5) >= 0.02::DOUBLE AS act,
  CASE WHEN p >= 0.5 THEN form_diff ELSE -form_diff END AS score, (p >= 0.5) = (market >= 0.5) AS agree, greatest(market, 1 - market) AS fav,
  CASE WHEN match_id % 4 = 2 AND match_id % 3 = 2 THEN 'advancement' WHEN (match_id // 5) % 3 = 2 AND (match_id // 7) % 3 = 2 THEN 'elimination' ELSE 'standard' END AS kind FROM f)"""


def settled(f: DataFrame) -> DataFrame:
    return f.withColumn("substitute", F.expr("cast(match_id % 9 = 0 as int)"))


def on_settled(f):
    return on_forecasts(lambda x: f(settled(x)))


def outcome_sql(on: str, out: str) -> str:
    return f"""count_if({on} AND {out}) AS avoided, count_if({on} AND NOT ({out})) AS picks, count_if({on} AND NOT ({out}) AND hit) AS hits,
      coalesce(count_if({on} AND NOT ({out}) AND hit) / nullif(count_if({on} AND NOT ({out})), 0)::DOUBLE, 0) AS accuracy, coalesce(count_if({on} AND NOT ({out})) / nullif(count_if({on}), 0)::DOUBLE, 0) AS coverage,
      count_if({on} AND {out} AND hit) AS avoided_wins, count_if({on} AND {out} AND NOT hit) AS avoided_losses"""


add("form_policy_candidates", on_settled(policies.form_policies), f"SELECT c AS confidence, {outcome_sql('true', '(score < 0 AND form_confidence >= c)')} FROM r, (SELECT unnest([0, 0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS c) GROUP BY c", "confidence accuracy coverage", R_SQL)
add("favourite_form_candidates", on_settled(policies.favourite_policies), f"SELECT c AS probability, {outcome_sql('act', '(agree AND fav >= c AND score < 0)')} FROM r, (SELECT unnest([0.55, 0.6, 0.65, 0.7]::DOUBLE[]) AS c) GROUP BY c", "probability accuracy coverage", R_SQL)
add("status_policy_candidates", on_settled(policies.status_policies), f"""SELECT c AS confidence, m AS margin, count_if(act AND gap <= m AND substitute >= 1) AS substitutes, count_if(act AND gap <= m AND form_confidence < c) AS low_samples,
    {outcome_sql('act', '(gap <= m AND (substitute >= 1 OR form_confidence < c))')} FROM r, (SELECT unnest([0.2, 0.4, 0.6]::DOUBLE[]) AS c), (SELECT unnest([0.06, 0.08, 0.1]::DOUBLE[]) AS m) GROUP BY c, m""", "confidence margin accuracy coverage", R_SQL)
RISKY = "(substitute >= 1 OR form_confidence < 0.4::DOUBLE)"
add("status_signal_risk", on_settled(policies.status_summary), f"""
    SELECT count(*) AS available, CAST(0 AS BIGINT) AS missing, count_if(act AND {RISKY}) AS risky_picks, count_if(act AND form_confidence < 0.4::DOUBLE) AS low_samples, count_if(act AND substitute >= 1) AS substitutes,
      avg(CASE WHEN act AND {RISKY} THEN hit::INT END) AS risky_accuracy, count_if(act AND NOT {RISKY}) AS other_picks, avg(CASE WHEN act AND NOT {RISKY} THEN hit::INT END) AS other_accuracy,
      count_if(NOT act AND {RISKY} AND hit) AS avoided_wins, count_if(NOT act AND {RISKY} AND NOT hit) AS avoided_losses FROM r""", "risky_accuracy other_accuracy", R_SQL)
add("counter_signal_risk", on_settled(policies.counter_signals), """
    SELECT count(*) AS available, count_if(score < 0) AS counter, count_if(score < 0 AND NOT hit) AS counter_losses, avg(CASE WHEN score < 0 THEN (NOT hit)::INT END) AS counter_loss_rate,
      count_if(score >= 0) AS aligned, count_if(score >= 0 AND NOT hit) AS aligned_losses, avg(CASE WHEN score >= 0 THEN (NOT hit)::INT END) AS aligned_loss_rate FROM r""", "counter_loss_rate aligned_loss_rate", R_SQL)
add("form_by_outcome", on_settled(policies.form_by_outcome), """
    SELECT count(form_diff) AS available, avg(CASE WHEN act AND hit THEN form_diff END) AS picked_hits, avg(CASE WHEN act AND NOT hit THEN form_diff END) AS picked_misses, avg(CASE WHEN hit THEN form_diff END) AS hits,
      avg(CASE WHEN NOT hit THEN form_diff END) AS misses, avg(CASE WHEN NOT hit THEN form_confidence END) AS misses_confidence FROM r""", "picked_hits picked_misses hits misses misses_confidence", R_SQL)
RECORDS = ("match_id % 4 as wins1", "match_id % 3 as wins2", "(match_id div 5) % 3 as losses1", "(match_id div 7) % 3 as losses2")
add("swiss_pressure_buckets", on_settled(lambda f: policies.pressure_buckets(f.selectExpr("*", *RECORDS).withColumn("kind", swiss.match_type()))), """
    SELECT kind, count(gap) AS n, count_if(act) AS picks, count_if(act AND hit) AS hits, coalesce(avg(CASE WHEN act THEN hit::INT END), 0) AS accuracy, count_if(hit) AS directional, avg(gap) AS margin
    FROM (SELECT unnest(['advancement', 'elimination', 'standard', 'unknown']) AS kind) LEFT JOIN r USING (kind) GROUP BY kind""", "accuracy margin", R_SQL)
add("recommended_threshold", on_forecasts(policies.recommended_threshold), """
    SELECT * FROM (SELECT t AS threshold, count_if(abs(p - 0.5) >= t) AS picks, count_if(abs(p - 0.5) >= t AND (p >= 0.5) = (label = 1)) AS correct FROM f, (SELECT unnest([0.0, 0.02, 0.05, 0.08, 0.10, 0.12, 0.15]::DOUBLE[]) AS t) GROUP BY t)
    WHERE picks >= 2 ORDER BY correct / picks DESC, correct DESC, threshold LIMIT 1""", "threshold", F_SQL)


def pressed_picks(m: DataFrame) -> DataFrame:
    return policies.checkpoint_pressure(stage_picks(m).withColumn("state", swiss.checkpoint()))


PRESSURE_SQL = PICK_SQL + f""", z AS (SELECT *, CASE WHEN category <> '0-3' THEN greatest(0, 3 - wins) END AS wins_to_lock, CASE WHEN category = '0-3' THEN greatest(0, 3 - losses) END AS losses_to_lock,
    CASE category WHEN '3-0' THEN greatest(0, 1 - losses) WHEN 'advance' THEN greatest(0, 3 - losses) END AS losses_to_break, CASE WHEN category = '0-3' THEN greatest(0, 1 - wins) END AS wins_to_break,
    CAST(state = 'alive' AND CASE WHEN category = '0-3' THEN losses = 2 ELSE wins = 2 END AS INT) AS can_lock,
    CAST(state = 'alive' AND CASE category WHEN '3-0' THEN losses = 0 WHEN '0-3' THEN wins = 0 ELSE losses = 2 END AS INT) AS can_break FROM (SELECT *, {STATE} AS state FROM k))"""
add("checkpoint_pressure", on_matches(pressed_picks), "SELECT * FROM z", "", PRESSURE_SQL)
add("checkpoint_summary", on_matches(lambda m: policies.checkpoint_summary(pressed_picks(m).selectExpr("*", "(team * 7 + stage) % 11 / 10D as confidence", "if(team % 2 = 0, 'High', 'low') as tier", "(team + stage) % 4 = 0 as risk"))), """
    SELECT category, count(*) AS picks, avg(confidence) AS confidence, count_if(state = 'locked') AS locked, count_if(state = 'alive') AS alive, count_if(state = 'broken') AS broken, count_if(state = 'missing') AS missing,
      count_if(state = 'broken' AND team % 2 = 0) AS high_tier_broken, count_if(risk) AS risky, avg(CASE WHEN risk THEN (state = 'broken')::INT END) AS risky_broken_rate, avg(CASE WHEN NOT risk THEN (state = 'broken')::INT END) AS other_broken_rate,
      count_if(state = 'alive' AND can_lock + can_break > 0) AS pressed, count_if(state = 'alive' AND can_lock + can_break > 0 AND risk) AS risky_pressed
    FROM (SELECT *, (team * 7 + stage) % 11 / 10.0::DOUBLE AS confidence, (team + stage) % 4 = 0 AS risk FROM z) GROUP BY category""", "confidence risky_broken_rate other_broken_rate", PRESSURE_SQL)

# ---------------------------------------------------------------- tickets
RANKED = ("stage", "team as seed_no", "((team * 7 + stage) % 16) / 16D as p_30", "((team * 5 + stage) % 16) / 16D as p_03", "((team * 3 + stage) % 16) / 16D as p_advance", "cast(1 + (team * 11 + stage) % 32 as double) as rank", "wins / (wins + losses) as bo1_winrate",
          "((team * 5) % 9) / 9D as map_depth", "((team * 7) % 5 - 2) / 10D as form_score", "((team * 3 + stage) % 5 - 2) / 10D as form_trend", "((team * 13) % 16) / 15D as sample_confidence", "cast(team % 6 = 0 as int) as substitute")
BY = ("stage",)


def ranked_teams(m: DataFrame) -> DataFrame:
    """The teams of each stage with what is known of them."""
    return tickets.risk_scores(swiss.standings(in_stages(m), "stage").selectExpr(*RANKED), "challengers", by=BY)


def chosen(m: DataFrame) -> DataFrame:
    return tickets.margins(ranked_teams(m), tickets.choose(ranked_teams(m), by=BY), BY)


SCORE_SQL = STAGE_SQL + """, t AS (SELECT stage, team AS id, ((team * 7 + stage) % 16) / 16.0::DOUBLE AS p_30, ((team * 5 + stage) % 16) / 16.0::DOUBLE AS p_03, ((team * 3 + stage) % 16) / 16.0::DOUBLE AS p_advance, (1 + (team * 11 + stage) % 32)::DOUBLE AS rank,
    greatest(-0.04, least(0.06, (wins / (wins + losses)::DOUBLE - 0.5) * 0.1 + (((team * 5) % 9) / 9.0::DOUBLE - 0.5) * 0.08)) AS st, greatest(-0.035, least(0.035, ((team * 7) % 5 - 2) / 10.0::DOUBLE * 0.12 + ((team * 3 + stage) % 5 - 2) / 10.0::DOUBLE * 0.08)) AS fo,
    1 - ((team * 13) % 16) / 15.0::DOUBLE AS un, CAST(team % 6 = 0 AS INT)::DOUBLE AS su FROM st),
  tg AS (SELECT *, rank - min(rank) OVER (PARTITION BY stage) AS gap FROM t),
  v AS (SELECT stage, id AS seed_no, '3-0' AS category, rank, p_30 AS base, (p_30 + st + fo) * CASE WHEN gap > 15 THEN 0.75 ELSE 1 END * greatest(0.84, 1 - un * 0.12 - su * 0.08) AS score FROM tg UNION ALL
    SELECT stage, id, '0-3', rank, p_03, (p_03 - fo) * (1 + least(rank, 80) / 200) * least(1.08, 1 + un * 0.04 + su * 0.03) FROM tg UNION ALL
    SELECT stage, id, 'advance', rank, p_advance, (p_advance + st + fo) * CASE WHEN gap > 15 THEN 0.75 ELSE 1 END * greatest(0.9, 1 - un * 0.05 - su * 0.04) FROM tg)"""
TICKET_SQL = SCORE_SQL + """, a AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY score DESC, rank, seed_no) AS place FROM v WHERE category = '3-0' QUALIFY place <= 2),
  b AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY score DESC, rank DESC, seed_no) AS place FROM v WHERE category = '0-3' AND (stage, seed_no) NOT IN (SELECT (stage, seed_no) FROM a) QUALIFY place <= 2),
  c AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY score DESC, rank, seed_no) AS place FROM v WHERE category = 'advance' AND (stage, seed_no) NOT IN (SELECT (stage, seed_no) FROM a) AND (stage, seed_no) NOT IN (SELECT (stage, seed_no) FROM b) QUALIFY place <= 6),
  picks AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
  mg AS (SELECT stage, category, seed_no, score, next_best, score - next_best AS margin FROM picks LEFT JOIN (SELECT stage, category, max(score) AS next_best FROM v WHERE (stage, seed_no) NOT IN (SELECT (stage, seed_no) FROM picks) GROUP BY stage, category) USING (stage, category))"""
add("ticket_risk_scores", on_matches(lambda m: ranked_teams(m).select("stage", "seed_no", "category", "rank", "base", "score")), "SELECT * FROM v", "rank base score", SCORE_SQL)
add("ticket_by_score", on_matches(lambda m: tickets.choose(ranked_teams(m), by=BY)), "SELECT stage, category, place, seed_no, score FROM picks", "score", TICKET_SQL)
add("ticket_margins", on_matches(chosen), "SELECT * FROM mg", "score next_best margin", TICKET_SQL)
add("answer_sheet", on_matches(lambda m: tickets.answer_sheet(chosen(m), by=BY)), """
    SELECT w.stage, w.category, coalesce(picks, 0) AS picks, coalesce(seeds, '') AS seeds, least_margin, array_to_string(list_filter([CASE WHEN coalesce(picks, 0) <> w.n THEN 'slots' END, CASE WHEN least_margin < 0.04 THEN 'narrow' END, CASE WHEN unknown > 0 THEN 'unknown_margin' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM (SELECT DISTINCT stage, category, n FROM mg, (VALUES ('3-0', 2), ('0-3', 2), ('advance', 6)) s(category, n)) w LEFT JOIN (SELECT stage, category, count(*) AS picks, string_agg(seed_no, ',' ORDER BY seed_no) AS seeds, min(margin) AS least_margin, count_if(margin IS NULL) AS unknown FROM mg GROUP BY ALL) g
      ON g.stage = w.stage AND g.category = w.category""".replace("SELECT DISTINCT stage, category, n FROM mg,", "SELECT DISTINCT mg.stage, s.category, n FROM mg,"), "least_margin", TICKET_SQL)
add("greedy_ticket", on_matches(lambda m: readiness.ticket(swiss.standings(in_stages(m), "stage").selectExpr(*RANKED[:5]), by=BY)), """
    SELECT stage, '3-0' AS category, id AS seed_no, p_30 AS p FROM ga UNION ALL SELECT stage, '0-3', id, p_03 FROM gb UNION ALL SELECT stage, 'advance', id, p_advance FROM gc""", "p", SCORE_SQL + """,
    ga AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY stage ORDER BY p_30 DESC, id) <= 2), gb AS (SELECT * FROM t WHERE (stage, id) NOT IN (SELECT (stage, id) FROM ga) QUALIFY row_number() OVER (PARTITION BY stage ORDER BY p_03 DESC, id) <= 2),
    gc AS (SELECT * FROM t WHERE (stage, id) NOT IN (SELECT (stage, id) FROM ga) AND (stage, id) NOT IN (SELECT (stage, id) FROM gb) QUALIFY row_number() OVER (PARTITION BY stage ORDER BY p_advance DESC, id) <= 6)""")


def stage_samples(m: DataFrame) -> DataFrame:
    """Stages in place of simulations, teams in place of seeds: records cut to three wins and losses."""
    return stage_picks(m).selectExpr("stage as sim", "team as seed_no", "least(wins, 3) as wins", "if(wins >= 3, least(losses, 2), least(losses, 3)) as losses")


SAMPLE_SQL = PICK_SQL + """, g AS (SELECT stage AS sim, team AS seed_no, least(wins, 3) AS wins, CASE WHEN wins >= 3 THEN least(losses, 2) ELSE least(losses, 3) END AS losses FROM st),
  fp AS (SELECT seed_no, category, count(*) AS n, avg((CASE category WHEN '3-0' THEN wins = 3 AND losses = 0 WHEN '0-3' THEN losses = 3 AND wins = 0 ELSE wins = 3 AND losses > 0 END)::INT) AS p FROM g, (SELECT unnest(['3-0', '0-3', 'advance']) AS category) GROUP BY ALL)"""
add("field_probabilities", on_matches(lambda m: tickets.field(stage_samples(m))), "SELECT seed_no, category, p, n FROM fp", "p", SAMPLE_SQL)
add("leveraged_reward", on_matches(lambda m: tickets.leveraged_reward(stage_samples(m), stage_picks(m).select(F.col("team").alias("seed_no"), "category").distinct(), 0.5)),
    "SELECT sum(p * pow(1 / greatest(p, 1 / n::DOUBLE), 0.5)) AS reward, count(*) AS picks FROM fp JOIN (SELECT DISTINCT team AS seed_no, category FROM k) USING (seed_no, category)", "reward", SAMPLE_SQL)
add("ticket_distribution", on_matches(lambda m: swiss.ticket_hits(stage_samples(m), stage_picks(m).select("category", F.col("team").alias("seed_no")).distinct())), """
    SELECT hits, count(*) AS n, CAST(hits >= 5 AS INT) AS passes FROM (SELECT sim, count_if(CASE category WHEN '3-0' THEN wins = 3 AND losses = 0 WHEN '0-3' THEN losses = 3 AND wins = 0 ELSE wins = 3 AND losses > 0 END) AS hits FROM g JOIN (SELECT DISTINCT category, team FROM k) p ON p.team = g.seed_no GROUP BY sim) GROUP BY hits""", "", SAMPLE_SQL)
add("most_likely_record", on_matches(lambda m: tickets.outcomes(stage_samples(m).groupBy("seed_no", F.concat_ws("-", "wins", "losses").alias("record")).agg((F.count("*") / 100).alias("p")))), """
    SELECT seed_no, arg_max(record, (p, record)) AS record, max(p) AS p, sum(CASE WHEN record LIKE '3-%' THEN p ELSE 0 END) AS advance, 1 - sum(CASE WHEN record LIKE '3-%' THEN p ELSE 0 END) AS eliminate
    FROM (SELECT seed_no, wins || '-' || losses AS record, count(*) / 100.0::DOUBLE AS p FROM g GROUP BY ALL) GROUP BY seed_no""", "p advance eliminate", SAMPLE_SQL)

# ---------------------------------------------------------------- pages and payloads, written from the match view and read back
CARD = """concat('<div class="result-con"><a class="a-reset" href="/matches/', match_id, '"><span class="team1">Team ', team1, '</span> <div class="team2"><b>Team &amp; ', team2, '</b></div><span class="score-won">', score1, '</span> - <span class="score-lost">', score2,
  '</span>', if(match_id % 5 = 0, '', concat('<span class="event-name">', element_at(array('IEM Cup', 'CCT Cup', 'Open Cup'), cast(match_id % 3 + 1 as int)), '</span>')), '<span class="map-text">', upper(map), '</span>',
  if(match_id % 2 = 0, concat('<span class="date">', date_from_unix_date(cast(day as int)), ' 18:00</span>'), concat('<span data-unix="', day * 86400000 + 3600000, '">x</span>')), '<i> bo', best_of, ' </i></a></div>') as card"""
PAYLOAD = """to_json(named_struct('data', named_struct('matches', array(named_struct('mc_info', named_struct('id', match_id, 't1_info', named_struct('disp_name', concat(' Team ', team1, ' ')), 't2_info', named_struct('name', concat('Team ', team2)),
  'plan_ts', day * 86400 + 60000, 'format', match_id % 7, 'round_name', 'R1'), 'state', named_struct('t1_score', score1, 't2_score', score2, 't1_odds', odds1, 'status', match_id % 5, 'bout_states', array(named_struct('bout_num', 1, 'map_name', map, 't1_score', score1, 't2_score', score2, 'result', 't2', 'status', 2),
  named_struct('bout_num', 2, 'map_name', 'x', 't1_score', cast(null as bigint), 't2_score', score2, 'result', if(match_id % 3 = 0, '', 't1'), 'status', 9))), 'tt_info', named_struct('disp_name', 'Cup', 'grade', '1')))))) as payload"""


def result_pages(m: DataFrame) -> DataFrame:
    return m.selectExpr("match_id div 20 as page_id", "match_id", CARD).groupBy("page_id").agg(F.concat(F.lit('<html class="page">'), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("match_id", "card"))), lambda x: x.card), "\n"), F.lit("</html>")).alias("html"))


def service_rows(m: DataFrame) -> DataFrame:
    return results_api.parsed(m.selectExpr(PAYLOAD))


add("result_cards", on_matches(lambda m: pages.match_cards(result_pages(m)).withColumn("date", F.unix_date("date").cast("long")).select("page_id", "date", "event", "tier", "team1", "team2", "score1", "score2", "best_of", "map", "link", "winner")), """
    SELECT match_id // 20 AS page_id, day AS date, coalesce(e, 'unknown') AS event, CASE e WHEN 'IEM Cup' THEN 'S' WHEN 'CCT Cup' THEN 'A' ELSE 'B' END AS tier, 'Team ' || team1 AS team1, 'Team & ' || team2 AS team2, score1, score2, best_of, map, '/matches/' || match_id AS link,
      CASE WHEN score1 >= score2 THEN 'Team ' || team1 ELSE 'Team & ' || team2 END AS winner FROM (SELECT *, CASE WHEN match_id % 5 > 0 THEN ['IEM Cup', 'CCT Cup', 'Open Cup'][match_id % 3 + 1] END AS e FROM m)""", "", MATCH_SQL)
add("service_matches", on_matches(lambda m: results_api.matches(service_rows(m)).withColumn("date", F.unix_date("date").cast("long")).select("match_id", "date", "event", "grade", "best_of", "status", "team1", "team2", "score1", "score2", "winner", "odds1", "n_maps")), """
    SELECT CAST(match_id AS VARCHAR) AS match_id, day + 1 AS date, 'Cup' AS event, '1' AS grade, CAST([1, 1, 3, 3, 5, 5, 2][match_id % 7 + 1] AS BIGINT) AS best_of, ['upcoming', 'live', 'completed', 'cancelled', '4'][match_id % 5 + 1] AS status, 'Team ' || team1 AS team1, 'Team ' || team2 AS team2,
      score1, score2, CASE WHEN score1 > score2 THEN 'Team ' || team1 WHEN score2 > score1 THEN 'Team ' || team2 END AS winner, odds1, CAST(2 AS BIGINT) AS n_maps FROM m""", "odds1", MATCH_SQL)
add("service_maps", on_matches(lambda m: results_api.maps(service_rows(m))), """
    SELECT CAST(match_id AS VARCHAR) AS match_id, CAST(1 AS BIGINT) AS bout_num, map, score1, score2, CASE WHEN score1 > score2 THEN 'Team ' || team1 ELSE 'Team ' || team2 END AS winner, 'completed' AS status FROM m
    UNION ALL SELECT CAST(match_id AS VARCHAR), 2, 'x', NULL, score2, CASE WHEN match_id % 3 > 0 THEN 'Team ' || team1 END, '9' FROM m""", "", MATCH_SQL)
add("service_page_token", on_matches(lambda m: results_api.page_token(service_rows(m)).select("ts", F.array_join("ids", ",").alias("ids"))),
    "SELECT min(day) * 86400 + 60000 AS ts, (SELECT string_agg(CAST(match_id AS VARCHAR), ',' ORDER BY CAST(match_id AS VARCHAR)) FROM m WHERE day = (SELECT min(day) FROM m)) AS ids FROM m", "", MATCH_SQL)


#: A row of a script's array, with brackets and quotes inside its strings.
SCRIPT_ROW = """concat('{"id": ', match_id, ', name: "a ] \\\\" [', team1, '", \\'map\\': "', map, '", "scores": [', score1, ', ', score2, ']}') as row"""
SCRIPT_SCHEMA = "id: bigint, name: string, map: string, scores: array<bigint>"


def script_pages(m: DataFrame) -> DataFrame:
    """Pages of twenty matches; one in seven is the firewall's, one has no end."""
    rows = m.selectExpr("match_id div 20 as page_id", "match_id", SCRIPT_ROW).groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("match_id", "row"))), lambda x: x.row), ", ").alias("all"))
    head, end = F.when(F.col("page_id") % 7 == 0, "<script src=aliyun_waf>").otherwise("<script>"), F.when(F.col("page_id") % 7 == 1, "").otherwise("]; var more = [1, 2];</script>")
    return rows.select("page_id", F.concat(head, F.lit("var other = ['x']; window.matches = ["), "all", end).alias("html"))


add("script_rows", on_matches(lambda m: team_pages.read_pages(script_pages(m), "window.matches", SCRIPT_SCHEMA).select("page_id", F.inline("rows")).select("page_id", "id", "name", "map", F.get("scores", 0).alias("score1"), F.get("scores", 1).alias("score2"))),
    """SELECT match_id // 20 AS page_id, match_id AS id, 'a ] " [' || team1 AS name, map, score1, score2 FROM m WHERE match_id // 20 % 7 > 1""", "", MATCH_SQL)
add("script_page_counts", on_matches(lambda m: team_pages.status_counts(team_pages.read_pages(script_pages(m), "window.matches", SCRIPT_SCHEMA))), """
    SELECT status, count(DISTINCT page) AS pages, CAST(sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS n_rows FROM (SELECT match_id // 20 AS page, CASE match_id // 20 % 7 WHEN 0 THEN 'blocked' WHEN 1 THEN 'unparsed' ELSE 'ok' END AS status FROM m) GROUP BY status""", "", MATCH_SQL)


# ---------------------------------------------------------------- further joins
def _intel(m: DataFrame) -> DataFrame:
    return m.filter("tier <> 'C'").selectExpr("day", "team2 as team1", "team1 as team2", "case when match_id % 3 = 0 then 'de_Nuke' when match_id % 3 = 1 then 'TBD' end as map", "concat('s', match_id % 4) as source", "(match_id % 10) / 10D as confidence", "cast(match_id as string) as bans1", "cast(-match_id as string) as bans2", "match_id as seq")


add("veto_intel_merge", on_matches(lambda m: joins.merge_veto(m.select("match_id", "day", "team1", "team2", "map"), _intel(m)).drop("day", "team1", "team2")), """
    SELECT m.match_id, CASE WHEN q % 3 = 0 THEN 'nuke' ELSE map END AS map, CAST(q IS NOT NULL AS INT) AS veto_applied, 's' || (q % 4) AS veto_source, (q % 10) / 10.0::DOUBLE AS veto_confidence,
      CASE WHEN m.team1 = first THEN CAST(q AS VARCHAR) ELSE CAST(-q AS VARCHAR) END AS bans1, CASE WHEN m.team1 = first THEN CAST(-q AS VARCHAR) ELSE CAST(q AS VARCHAR) END AS bans2
    FROM m LEFT JOIN (SELECT day, least(team1, team2) AS lo, greatest(team1, team2) AS hi, max(match_id) AS q, arg_max(team2, match_id) AS first FROM m WHERE tier <> 'C' GROUP BY ALL) v ON v.day = m.day AND lo = least(m.team1, m.team2) AND hi = greatest(m.team1, m.team2)""", "veto_confidence", MATCH_SQL)
add("team_metadata", lambda s, d: joins.merge_metadata(_own(s, d), read(s, d, "customer").selectExpr("c_custkey as team", "c_acctbal as balance"), ["balance"]).select("match_id", "balance1", "balance2"), """
    SELECT match_id, coalesce(CASE WHEN match_id % 3 = 0 THEN v1 END, a.c_acctbal) AS balance1, b.c_acctbal AS balance2 FROM m LEFT JOIN customer a ON a.c_custkey = team1 LEFT JOIN customer b ON b.c_custkey = team2""", "balance1 balance2", MATCH_SQL)


def _own(s, d) -> DataFrame:
    return match_view(s, d).selectExpr("match_id", "team1", "team2", "if(match_id % 3 = 0, v1, null) as balance1", "cast(null as double) as balance2")


IMPLIED = "1 / odds1 / (1 / odds1 + 1 / odds2)"
add("pair_odds_lookup", on_matches(lambda m: joins.pair_means(m.selectExpr("team1", "team2", f"{IMPLIED} as p1"))), f"SELECT least(team1, team2) AS lo, greatest(team1, team2) AS hi, avg(CASE WHEN team1 > team2 THEN 1 - {IMPLIED} ELSE {IMPLIED} END) AS p_lo, count(*) AS n FROM m GROUP BY ALL", "p_lo", MATCH_SQL)
add("market_strength", on_matches(lambda m: joins.market_strength(m.selectExpr("team1", "team2", f"{IMPLIED} as p1"))), f"SELECT team, avg(p) AS strength, count(*) AS n FROM (SELECT team1 AS team, {IMPLIED} AS p FROM m UNION ALL SELECT team2, 1 - {IMPLIED} FROM m) GROUP BY team", "strength", MATCH_SQL)
add("dataset_coverage", lambda s, d: readiness.coverage(_own(s, d), read(s, d, "customer").selectExpr("c_custkey as team"), 600, 40), """
    SELECT (SELECT count(*) FROM m) AS n_rows, (SELECT count(DISTINCT team) FROM l) AS n_teams, count(*) AS required, count_if(c_custkey IN (SELECT team FROM l)) AS covered, greatest(0, 600 - (SELECT count(*) FROM m)) AS rows_remaining, greatest(0, 40 - (SELECT count(DISTINCT team) FROM l)) AS teams_remaining FROM customer""", "", LONG_SQL)
add("source_freshness", lambda s, d: readiness.freshness(read(s, d, "nation").selectExpr("n_name as source", "case when n_nationkey % 5 = 0 then 'soon' else concat('2024-01-', lpad(cast(n_nationkey + 1 as string), 2, '0'), ' 06:30:00') end as stamp"), read(s, d, "region").selectExpr("r_name as source"), "2024-01-20 00:00:00", 240), """
    SELECT n_name AS source, CASE WHEN n_nationkey % 5 > 0 THEN (18 - n_nationkey) * 24 + 17.5 END::DOUBLE AS age_hours, CASE WHEN n_nationkey % 5 = 0 THEN 'invalid' WHEN (18 - n_nationkey) * 24 + 17.5 <= 240 THEN 'fresh' ELSE 'stale' END AS state FROM nation
    UNION ALL SELECT r_name, NULL, 'missing' FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)""", "age_hours")

# ---------------------------------------------------------------- further statistics and ratings
DRAWN_SQL = f"""dr AS (SELECT s, sum(v * k) / sum(k) AS x FROM (
      SELECT s, v, CAST(u >= 0.36787944117144233 AS INT) + CAST(u >= 0.7357588823428847 AS INT) + CAST(u >= 0.9196986029286058 AS INT) + CAST(u >= 0.9810118431238462 AS INT) + CAST(u >= 0.9963401531726563 AS INT) + CAST(u >= 0.9994058151824183 AS INT) AS k
      FROM (SELECT s, {LOSS} - ({LOSS.replace('(p)', '(p2)').replace('1 - p)', '1 - p2)')}) AS v, CAST(('0x' || substr(md5(s || '|' || match_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM f, range(1, 51) t(s))) GROUP BY s)"""
add("paired_bootstrap", on_forecasts(lambda f: evaluate.paired_bootstrap(f, "match_id", 50, evaluate.log_loss(F.col("p"), F.col("label")), evaluate.log_loss(F.col("p2"), F.col("label")))), f"""
    SELECT *, CASE WHEN low <= 0 AND high >= 0 THEN 'tie' WHEN delta < 0 THEN 'a' ELSE 'b' END AS better FROM (SELECT (SELECT avg({LOSS} - ({LOSS.replace('(p)', '(p2)').replace('1 - p)', '1 - p2)')})) FROM f) AS delta, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high,
      least(1, 2 * least(avg((x <= 0)::INT), avg((x >= 0)::INT)))::DOUBLE AS p_value FROM dr)""", "delta low high p_value", F_SQL + ", " + DRAWN_SQL)
add("diebold_mariano_lag3", on_forecasts(lambda f: evaluate.diebold_mariano(f, "match_id", 3)), """
    SELECT n, mean AS mean_difference, mean / sqrt((g0 + 2 * (2.0::DOUBLE / 3 * g1 + 1.0::DOUBLE / 3 * g2)) / n) * sqrt((n - 5 + 6.0::DOUBLE / n) / n) AS statistic FROM (SELECT count(*) AS n, max(mean) AS mean, avg(c * c) AS g0, sum(c * c1) / count(*) AS g1, sum(c * c2) / count(*) AS g2
      FROM (SELECT mean, c, lag(c, 1) OVER (ORDER BY match_id) AS c1, lag(c, 2) OVER (ORDER BY match_id) AS c2 FROM (SELECT match_id, avg(d) OVER () AS mean, d - avg(d) OVER () AS c FROM (SELECT match_id, pow(p - label, 2) - pow(p2 - label, 2) AS d FROM f))))""", "mean_difference statistic", F_SQL)
#: The continued fraction of the incomplete beta function, 200 terms.
TAIL_SQL = """tt AS (SELECT id, t, df, df / (df + t * t) AS x0, t * t / (df + t * t) AS y0, df / (df + t * t) < (df / 2 + 1) / (df / 2 + 2.5) AS near FROM tv),
  tu AS (SELECT *, CASE WHEN near THEN x0 ELSE y0 END AS x, CASE WHEN near THEN y0 ELSE x0 END AS y, CASE WHEN near THEN df / 2 ELSE 0.5 END::DOUBLE AS a, CASE WHEN near THEN 0.5 ELSE df / 2 END::DOUBLE AS b FROM tt),
  tn AS (SELECT *, list_transform(range(1, 201), lambda k: CASE WHEN k % 2 = 0 THEN (k // 2) * (b - k // 2) * x / ((a + k - 1) * (a + k)) ELSE -(a + k // 2) * (a + b + k // 2) * x / ((a + k // 2 * 2) * (a + k // 2 * 2 + 1)) END) AS terms FROM tu),
  th AS (SELECT *, list_reduce(list_concat([{'n': 0.0::DOUBLE, 'c': 1.0::DOUBLE, 'd': 0.0::DOUBLE, 'h': 1.0::DOUBLE}], list_transform(terms, lambda v: {'n': v, 'c': 0.0::DOUBLE, 'd': 0.0::DOUBLE, 'h': 0.0::DOUBLE})), lambda s, v:
    {'n': v.n, 'c': 1 + v.n / s.c, 'd': 1 / (1 + v.n * s.d), 'h': s.h * (1 + v.n / s.c) / (1 + v.n * s.d)}).h AS h FROM tn),
  tp AS (SELECT id, t, df, CASE WHEN t = 0 THEN 1 WHEN near THEN exp(a * ln(x) + b * ln(y) - (lgamma(a) + lgamma(b) - lgamma(a + b))) / a / h ELSE 1 - exp(a * ln(x) + b * ln(y) - (lgamma(a) + lgamma(b) - lgamma(a + b))) / a / h END AS p FROM th)"""
add("student_t_tails", on_forecasts(lambda f: f.selectExpr("match_id", "(p - market) * 8 as t", "cast(1 + match_id % 500 as double) as df").select("match_id", "t", "df", evaluate.student_t_tail(F.col("t"), F.col("df")).alias("p"))),
    "SELECT id AS match_id, t, df, p FROM tp", "t df p", F_SQL + ", tv AS (SELECT match_id AS id, (p - market) * 8 AS t, (1 + match_id % 500)::DOUBLE AS df FROM f), " + TAIL_SQL)
add("diebold_mariano_p", on_forecasts(lambda f: evaluate.diebold_mariano_test(f, "match_id")), "SELECT n, mean AS mean_difference, t AS statistic, p AS p_value FROM dm JOIN tp ON true", "mean_difference statistic p_value", F_SQL + """,
  dm AS (SELECT n, mean, mean / sqrt(g / n) * sqrt((n - 1)::DOUBLE / n) AS st FROM (SELECT count(*) AS n, avg(d) AS mean, var_pop(d) AS g FROM (SELECT pow(p - label, 2) - pow(p2 - label, 2) AS d FROM f))),
  tv AS (SELECT 1 AS id, st AS t, (n - 1)::DOUBLE AS df FROM dm), """ + TAIL_SQL)
add("map_prob_from_series", on_forecasts(lambda f: f.selectExpr("match_id", "p * p * (3 - 2 * p) as s3", "pow(p, 3) * (10 - 15 * p + 6 * p * p) as s5").select("match_id", market.map_probability("s3", 3).alias("p3"), market.map_probability("s5", 5).alias("p5"))), "SELECT match_id, p AS p3, p AS p5 FROM f", "p3 p5", F_SQL)
add("unknown_map_average", on_matches(lambda m: market.unknown_map_average(market.candidate_maps(form.team_profile(long_form(m)), m.select("match_id", "team1", "team2"), POOL), m.select("match_id", F.explode(F.array(*map(F.lit, POOL))).alias("map")).withColumn("p", (F.col("match_id") * 7 + F.length("map")) % 10 / 10.0), weighted=True)))
add("rolling_bt", on_matches(ratings.rolling_bradley_terry))
add("opponent_weighted_winrate", on_matches(lambda m: form.opponent_winrate(long_form(m), ratings.elo(m))))

# ---------------------------------------------------------------- playoff brackets
def entrants(s, d) -> DataFrame:
    return read(s, d, "customer").selectExpr("c_custkey div 8 as bracket", "c_custkey % 8 as place", "c_custkey as team")


def slot_picks(s, d) -> DataFrame:
    """Every team is picked up to a round that its key gives; later keys are later picks."""
    e = entrants(s, d).withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), 1 + (F.col("team") * 5) % 3)))
    return e.select("bracket", "round", F.expr("place div cast(pow(2, round) as bigint)").alias("slot"), F.col("team").alias("winner"), ((F.col("team") * 7) % 5 * 1_000_000_000 + F.col("team")).alias("seq"))


PLAYOFF_SQL = """e AS (SELECT c_custkey // 8 AS bracket, c_custkey % 8 AS place, c_custkey AS team FROM customer),
  pk AS (SELECT bracket, r AS round, place // CAST(2 ** r AS BIGINT) AS slot, team AS winner, (team * 7) % 5 * 1000000000 + team AS seq FROM e, range(1, 4) t(r) WHERE r <= 1 + (team * 5) % 3),
  lp AS (SELECT bracket, round, slot, arg_max(winner, seq) AS picked FROM pk GROUP BY ALL),
  r1 AS (SELECT bracket, 1::BIGINT AS round, place // 2 AS slot, max(CASE WHEN place % 2 = 0 THEN team END) AS team1, max(CASE WHEN place % 2 = 1 THEN team END) AS team2 FROM e GROUP BY ALL),
  w1 AS (SELECT r1.*, CASE WHEN picked IN (team1, team2) THEN picked END AS winner FROM r1 LEFT JOIN lp USING (bracket, round, slot)),
  r2 AS (SELECT bracket, 2::BIGINT AS round, slot // 2 AS slot, max(CASE WHEN slot % 2 = 0 THEN winner END) AS team1, max(CASE WHEN slot % 2 = 1 THEN winner END) AS team2 FROM w1 GROUP BY bracket, slot // 2),
  w2 AS (SELECT r2.*, CASE WHEN picked IN (team1, team2) THEN picked END AS winner FROM r2 LEFT JOIN lp USING (bracket, round, slot)),
  r3 AS (SELECT bracket, 3::BIGINT AS round, slot // 2 AS slot, max(CASE WHEN slot % 2 = 0 THEN winner END) AS team1, max(CASE WHEN slot % 2 = 1 THEN winner END) AS team2 FROM w2 GROUP BY bracket, slot // 2),
  w3 AS (SELECT r3.*, CASE WHEN picked IN (team1, team2) THEN picked END AS winner FROM r3 LEFT JOIN lp USING (bracket, round, slot)), w AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3)"""
add("playoff_bracket", lambda s, d: swiss.playoff(entrants(s, d), slot_picks(s, d)), "SELECT * FROM w", "", PLAYOFF_SQL)
add("pruned_picks", lambda s, d: swiss.pruned_picks(swiss.playoff(entrants(s, d), slot_picks(s, d)), slot_picks(s, d)), "SELECT * FROM pk WHERE (bracket, round, slot, winner) NOT IN (SELECT (bracket, round, slot, winner) FROM w WHERE winner IS NOT NULL)", "", PLAYOFF_SQL)

# ---------------------------------------------------------------- selection and calibration
SELECTABLE = {"v1": "v1", "v2": "v2", "odds1": "odds1", "gap": "v1 - v2", "one": "1D", "best_of": "cast(best_of as double)", "noise": "cast(match_id % 13 as double)"}
add("feature_selection", on_matches(lambda m: splits.selected_features(m.selectExpr("cast(winner = team1 as double) as label", *(f"{x} as {c}" for c, x in SELECTABLE.items())), list(SELECTABLE), "label", 4, ("best_of",))))
add("category_codes", on_matches(lambda m: splits.category_codes(m, "map", "day", "match_id")), "SELECT map, row_number() OVER (ORDER BY d, i) - 1 AS code FROM (SELECT map, min(day) AS d, arg_min(match_id, (day, match_id)) AS i FROM m GROUP BY map)", "", MATCH_SQL)
add("calibration_choice", on_forecasts(model.calibration_losses))
