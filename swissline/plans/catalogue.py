"""All registered queries on the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from swissline.functions import keys
from swissline.operators import backtest, cleaning, evaluate, features, form, joins, market, ratings, readiness, splits, store, swiss
from swissline.plans import forecast
from swissline.plans.registry import register
from swissline.sources import pages
from swissline.sources.matches import LONG_SQL, MATCH_SQL, long_form, match_view, read

TIE = 1e-9  # the engines round exact ties apart
REFERENCE_DAY = 19_740  # 2024-01-18
#: Forecasts of the match view: any smooth function of the row that both engines compute alike.
FORECAST = (
    "match_id", "day", "map", "best_of", "tier", "winner = team1 as won", "cast(winner = team1 as int) as label",
    "0.05D + 0.9D * ((match_id * 37) % 101) / 101D as p", "0.05D + 0.9D * ((match_id * 53) % 97) / 97D as market", "0.05D + 0.9D * ((match_id * 29) % 89) / 89D as p2",
    "((match_id * 7) % 21 - 10) / 10D as form_diff", "((match_id * 11) % 10) / 10D as form_confidence",
)
F_SQL = MATCH_SQL + """, f AS (SELECT match_id, day, map, best_of, tier, CAST(winner = team1 AS INT) AS label,
  0.05::DOUBLE + 0.9::DOUBLE * ((match_id * 37) % 101) / 101 AS p, 0.05::DOUBLE + 0.9::DOUBLE * ((match_id * 53) % 97) / 97 AS market, 0.05::DOUBLE + 0.9::DOUBLE * ((match_id * 29) % 89) / 89 AS p2,
  ((match_id * 7) % 21 - 10) / 10.0::DOUBLE AS form_diff, ((match_id * 11) % 10) / 10.0::DOUBLE AS form_confidence FROM m)"""


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    return match_view(spark, d).selectExpr(*FORECAST)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(F.col(c.name) + TIE, 6) + 0.0).alias(c.name) if isinstance(c.dataType, DoubleType) else F.col(c.name) for c in df.schema))


def _counts(sql: str) -> str:
    """count_if(x) as count(CASE WHEN x THEN 1 END), which is a bigint in the oracle's engine."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def add(name: str, query: Callable, sql: str | None = None, doubles: str = "", base: str = "") -> None:
    """doubles: names of the result's double columns, rounded on both sides."""
    if sql:
        replace = ", ".join(f"round({c} + {TIE}, 6) + 0.0 AS {c}" for c in doubles.split())
        sql = (f"WITH {base} " if base else "") + f"SELECT * {f'REPLACE ({replace}) ' if replace else ''}FROM ({_counts(sql)}) q"
    register(name, sql)(lambda spark, d: rounded(query(spark, d)))


STAGE_SQL = LONG_SQL + ", st AS (SELECT match_id // 60 AS stage, team, CAST(sum(won) AS BIGINT) AS wins, CAST(count(*) - sum(won) AS BIGINT) AS losses FROM l GROUP BY ALL)"
PICK_SQL = STAGE_SQL + ", k AS (SELECT *, ['3-0', 'advance', '0-3'][team % 3 + 1] AS category FROM st)"
STATE = """CASE category WHEN '3-0' THEN CASE WHEN wins >= 3 AND losses = 0 THEN 'locked' WHEN losses > 0 THEN 'broken' ELSE 'alive' END WHEN '0-3' THEN CASE WHEN losses >= 3 AND wins = 0 THEN 'locked' WHEN wins > 0 THEN 'broken' ELSE 'alive' END
      ELSE CASE WHEN wins >= 3 AND losses = 0 THEN 'broken' WHEN wins >= 3 THEN 'locked' WHEN losses >= 3 THEN 'broken' ELSE 'alive' END END"""


def in_stages(m: DataFrame) -> DataFrame:
    """Sixty matches make a stage."""
    return m.withColumn("stage", F.expr("match_id div 60"))


def stage_picks(m: DataFrame) -> DataFrame:
    """A pick for each team of each stage."""
    return swiss.standings(in_stages(m), "stage").withColumn("category", F.element_at(F.array(F.lit("3-0"), F.lit("advance"), F.lit("0-3")), (F.col("team") % 3 + 1).cast("int")))



def on_long(f: Callable) -> Callable:
    return lambda s, d: f(long_form(match_view(s, d)))


def on_matches(f: Callable) -> Callable:
    return lambda s, d: f(match_view(s, d))


def on_forecasts(f: Callable) -> Callable:
    return lambda s, d: f(forecasts(s, d))


# ---------------------------------------------------------------- form
for n in (5, 10):
    add(f"recent_winrate_{n}", on_long(lambda x, n=n: form.recent_winrate(x, n)),
        f"SELECT match_id, side, team, coalesce(avg(won) OVER (PARTITION BY team ORDER BY day, match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0.5) AS winrate FROM l", "winrate", LONG_SQL)
add("matches_30d", on_long(lambda x: form.matches_since(x)),
    "SELECT x.match_id, x.side, x.team, (SELECT count(*) FROM l y WHERE y.team = x.team AND y.day >= x.day - 30 AND (y.day < x.day OR y.day = x.day AND y.match_id < x.match_id)) AS n_matches FROM l x", "", LONG_SQL)
add("mode_winrate_182d", on_long(lambda x: form.mode_winrate(x)),
    """SELECT x.match_id, x.side, x.team, coalesce(avg(y.won), 0.5) AS winrate FROM l x LEFT JOIN l y ON y.team = x.team AND y.best_of = x.best_of AND y.day >= x.day - 182 AND (y.day < x.day OR y.day = x.day AND y.match_id < x.match_id)
    GROUP BY ALL""", "winrate", LONG_SQL)
add("map_winrate", on_long(form.map_winrate), "SELECT match_id, side, team, coalesce(avg(won) OVER (PARTITION BY team, map ORDER BY day, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5) AS winrate FROM l", "winrate", LONG_SQL)
add("streak", on_long(form.streak), """
    SELECT match_id, side, team, CAST(coalesce(lag(run) OVER (PARTITION BY team ORDER BY day, match_id), 0) AS BIGINT) AS streak FROM (
      SELECT *, row_number() OVER (PARTITION BY team, won, island ORDER BY day, match_id) * CASE WHEN won > 0 THEN 1 ELSE -1 END AS run FROM (
        SELECT *, row_number() OVER (PARTITION BY team ORDER BY day, match_id) - row_number() OVER (PARTITION BY team, won ORDER BY day, match_id) AS island FROM l))""", "", LONG_SQL)
add("h2h_last3", on_matches(form.h2h), """
    SELECT match_id, coalesce((SELECT avg(CAST(w = team1 AS DOUBLE)) FROM unnest(last) t(w)), 0.5) AS h2h FROM (
      SELECT match_id, team1, list(winner) OVER (PARTITION BY least(team1, team2), greatest(team1, team2) ORDER BY day, match_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS last FROM m)""", "h2h", MATCH_SQL)
add("player_fill", on_long(lambda x: form.fill_from_history(x.withColumn("own", F.when(F.col("match_id") % 5 != 0, F.col("v"))), "own", 1.0)),
    "SELECT match_id, side, team, coalesce(own, avg(own) OVER (PARTITION BY team ORDER BY day, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS filled FROM (SELECT *, CASE WHEN match_id % 5 <> 0 THEN v END AS own FROM l)", "filled", LONG_SQL)
add("decayed_winrate", on_long(lambda x: form.decayed_winrate(x, 30.0, 2.0)), """
    SELECT match_id, side, team, coalesce((w / own + 1.0) / (t / own + 2.0), 0.5) AS winrate FROM (SELECT *, pow(2.0, (day - 19000) / 30.0) AS own,
      sum(won * pow(2.0, (day - 19000) / 30.0)) OVER (PARTITION BY team ORDER BY day, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w,
      sum(pow(2.0, (day - 19000) / 30.0)) OVER (PARTITION BY team ORDER BY day, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM l)""", "winrate", LONG_SQL)
add("team_profile", on_long(form.team_profile), """
    SELECT team, map, n, winrate, CAST(greatest(4 - row_number() OVER (PARTITION BY team ORDER BY n DESC, d, i), 0) AS INT) AS preferred, CAST(row_number() OVER (PARTITION BY team ORDER BY n, map) <= 3 AS INT) AS banned FROM (
      SELECT team, map, count(*) AS n, avg(won) AS winrate, min(day) AS d, arg_min(match_id, (day, match_id)) AS i FROM l GROUP BY ALL)""", "winrate", LONG_SQL)

# ---------------------------------------------------------------- cleaning
CLEAN = f"day >= {REFERENCE_DAY - 10} AND tier IN ('S', 'A') AND status <> 'forfeit'"
add("clean_matches", on_matches(lambda m: cleaning.quality_filter(m, REFERENCE_DAY, 10).select("match_id", "day", "tier")), f"SELECT match_id, day, tier FROM m WHERE {CLEAN}", "", MATCH_SQL)
add("outlier_loo_sigma", on_matches(lambda m: cleaning.drop_outliers(m, ["v1", "v2"]).select("match_id", "v1", "v2")), """
    SELECT match_id, v1, v2 FROM m, (SELECT count(*) - 1 AS n, sum(v1) AS s1, sum(v1 * v1) AS q1, sum(v2) AS s2, sum(v2 * v2) AS q2 FROM m) t
    WHERE abs(v1 - (s1 - v1) / n) <= 3 * sqrt((q1 - v1 * v1) / n - pow((s1 - v1) / n, 2)) AND abs(v2 - (s2 - v2) / n) <= 3 * sqrt((q2 - v2 * v2) / n - pow((s2 - v2) / n, 2))""", "v1 v2", MATCH_SQL)
add("quality_scope_counts", on_matches(lambda m: cleaning.scope_counts(m, REFERENCE_DAY, 10)), f"""
    SELECT count(*) AS n_rows, count_if(day < {REFERENCE_DAY - 10}) AS n_old, count_if(tier NOT IN ('S', 'A')) AS n_low_tier, count_if(status = 'forfeit') AS n_bad_status, count_if(day > {REFERENCE_DAY}) AS n_future, count_if(winner IS NULL) AS n_no_winner FROM m""", "", MATCH_SQL)
add("required_fields", lambda s, d: cleaning.missing_fields(match_view(s, d).withColumn("note", F.when(F.col("match_id") % 3 > 0, "x")), ["map", "tier", "note"]),
    "SELECT 'map' AS field, 0 AS lacks UNION ALL SELECT 'tier', 0 UNION ALL SELECT 'note', CAST(max(CASE WHEN match_id % 3 > 0 THEN 0 ELSE 1 END) AS INT) FROM m", "", MATCH_SQL)
add("coerce_dialects", lambda s, d: read(s, d, "customer").select("c_custkey", *(keys.truthy(F.element_at(F.array(*map(F.lit, ("1", "yes", "sub", "on", "maybe", "0", "no", "2"))), (F.col("c_custkey") % 8 + 1).cast("int")), k).cast("int").alias(k) for k in ("cleaning", "features", "odds", "players", "update"))), """
    SELECT c_custkey, CAST(v IN ('1', 'yes') AS INT) AS cleaning, CAST(v NOT IN ('0', 'no') AS INT) AS features, CAST(v IN ('1', 'yes', '2') AS INT) AS odds, CAST(v IN ('1', 'yes', 'sub') AS INT) AS players, CAST(v IN ('1', 'yes', 'on') AS INT) AS update
    FROM (SELECT c_custkey, ['1', 'yes', 'sub', 'on', 'maybe', '0', 'no', '2'][c_custkey % 8 + 1] AS v FROM customer)""")

# ---------------------------------------------------------------- joins
def _odds(m: DataFrame) -> DataFrame:
    provider = F.explode(F.sequence(F.lit(0), F.lit(1)))
    o = m.withColumn("k", provider)
    return o.selectExpr("day + if(match_id % 3 = 0, 400, 0) as day", "team2 as team1", "team1 as team2", "1 / odds2 / (1 / odds1 + 1 / odds2) * (1 - 0.01 * k) as p1", "case when match_id % 2 = 0 and match_id % 3 > 0 then match_id end as link")


add("odds_merge", on_matches(lambda m: joins.merge_odds(m.withColumn("link", F.col("match_id")), _odds(m))), """
    SELECT match_id, CASE WHEN team1 < team2 THEN coalesce(a, b) ELSE 1 - coalesce(a, b) END AS p1, CASE WHEN a IS NOT NULL THEN 'link' WHEN b IS NOT NULL THEN 'pair' ELSE 'none' END AS basis FROM m
    LEFT JOIN (SELECT link, avg(v) AS a FROM o WHERE link IS NOT NULL GROUP BY link) ON link = match_id
    LEFT JOIN (SELECT day AS d, lo, hi, avg(v) AS b FROM o GROUP BY ALL) ON d = day AND lo = least(team1, team2) AND hi = greatest(team1, team2)""", "p1",
    MATCH_SQL + """, o AS (SELECT day + CASE WHEN match_id % 3 = 0 THEN 400 ELSE 0 END AS day, least(team1, team2) AS lo, greatest(team1, team2) AS hi, CASE WHEN match_id % 2 = 0 AND match_id % 3 > 0 THEN match_id END AS link, CASE WHEN team2 > team1 THEN 1 - p ELSE p END AS v
      FROM (SELECT *, 1 / odds2 / (1 / odds1 + 1 / odds2) * (1 - 0.01 * k) AS p FROM m, range(2) t(k)))""")


def _players(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").selectExpr("o_orderkey as pid", "o_custkey % 150 as team", "19723 + o_orderkey % 30 as day", "o_totalprice / 100000 as rating", "cast(o_orderkey % 9 = 0 as int) as is_sub")


PLAYER_SQL = LONG_SQL + ", p AS (SELECT o_orderkey AS pid, o_custkey % 150 AS team, 19723 + o_orderkey % 30 AS day, o_totalprice / 100000 AS rating, CAST(o_orderkey % 9 = 0 AS INT) AS is_sub FROM orders)"
add("player_window_15d", lambda s, d: joins.player_window(long_form(match_view(s, d)), _players(s, d)), """
    SELECT match_id, side, count(pid) AS n_players, avg(rating) AS rating, max(rating) AS star, max(is_sub) AS any_sub, arg_max(rating, (p.day, pid)) AS last_rating
    FROM l LEFT JOIN p ON p.team = l.team AND p.day < l.day AND p.day >= l.day - 15 GROUP BY match_id, side""", "rating star last_rating", PLAYER_SQL)
add("standings_merge", on_matches(lambda m: joins.merge_standings(in_stages(m), swiss.standings(in_stages(m), "stage").withColumn("stage", F.col("stage") + 1))), """
    SELECT match_id, CAST(coalesce(a.wins, 0) AS BIGINT) AS wins1, CAST(coalesce(a.losses, 0) AS BIGINT) AS losses1, CAST(coalesce(b.wins, 0) AS BIGINT) AS wins2, CAST(coalesce(b.losses, 0) AS BIGINT) AS losses2, CAST(1 + greatest(coalesce(a.wins + a.losses, 0), coalesce(b.wins + b.losses, 0)) AS BIGINT) AS swiss_round
    FROM m LEFT JOIN st a ON a.stage = match_id // 60 - 1 AND a.team = team1 LEFT JOIN st b ON b.stage = match_id // 60 - 1 AND b.team = team2""", "", STAGE_SQL)
add("version_asof", on_matches(lambda m: joins.as_of(m, m.sparkSession.createDataFrame([(19_728, "v1"), (19_735, "v2"), (19_742, "v3")], "day long, tag string"))),
    "SELECT match_id, CASE WHEN day >= 19742 THEN 'v3' WHEN day >= 19735 THEN 'v2' WHEN day >= 19728 THEN 'v1' ELSE 'unknown' END AS version FROM m", "", MATCH_SQL)


def _sided(m: DataFrame) -> DataFrame:
    return m.withColumns({"lo": F.least("team1", "team2"), "hi": F.greatest("team1", "team2")})


add("result_lookup_fallback", on_matches(lambda m: joins.lookup_unique(_sided(m), _sided(m.withColumn("day", F.col("day") + F.col("match_id") % 2)).withColumns({"rid": F.col("match_id"), "lo": F.when(F.col("match_id") % 4 < 2, F.col("lo")).otherwise(-1 - F.col("lo"))}))), """
    SELECT match_id, coalesce(e, k) AS rid, CASE WHEN e IS NOT NULL THEN 'exact' WHEN k IS NOT NULL THEN 'loose' ELSE 'none' END AS basis FROM s
    LEFT JOIN (SELECT day AS d, lo AS a, hi AS b, max(match_id) AS e FROM r GROUP BY ALL HAVING count(*) = 1) ON d = day AND a = lo AND b = hi
    LEFT JOIN (SELECT lo AS a2, hi AS b2, max(match_id) AS k FROM r GROUP BY ALL HAVING count(*) = 1) ON a2 = lo AND b2 = hi""", "",
    MATCH_SQL + ", s AS (SELECT *, least(team1, team2) AS lo, greatest(team1, team2) AS hi FROM m), r AS (SELECT match_id, day + match_id % 2 AS day, CASE WHEN match_id % 4 < 2 THEN lo ELSE -1 - lo END AS lo, hi FROM s)")
add("anti_missing_teams", lambda s, d: store.missing(read(s, d, "customer").select(F.col("c_custkey").alias("team")), match_view(s, d)), "SELECT c_custkey AS team FROM customer WHERE c_custkey NOT IN (SELECT team FROM l)", "", LONG_SQL)
add("best_signal", on_matches(lambda m: joins.best_signal(m.selectExpr("team1", "team2", "1 / odds1 / (1 / odds1 + 1 / odds2) as p1", "match_id % 3 as priority", "map as source", "match_id % 3 = 2 as proxy"))), """
    SELECT lo, hi, avg(v) AS p_lo, min(k) AS priority, array_to_string(list_sort(list(DISTINCT map)), '+') AS sources, CAST(min(CAST(k = 2 AS INT)) AS INT) AS proxy FROM (
      SELECT *, rank() OVER (PARTITION BY lo, hi ORDER BY k) AS o FROM (SELECT least(team1, team2) AS lo, greatest(team1, team2) AS hi, match_id % 3 AS k, map, CASE WHEN team1 > team2 THEN 1 - x ELSE x END AS v FROM (SELECT *, 1 / odds1 / (1 / odds1 + 1 / odds2) AS x FROM m))) WHERE o = 1 GROUP BY lo, hi""", "p_lo", MATCH_SQL)

# ---------------------------------------------------------------- ratings
#: One match after another, with a list of all ratings: for small tables.
ELO_SQL = LONG_SQL + """, tn AS (SELECT team, row_number() OVER (ORDER BY team) AS n FROM (SELECT DISTINCT team FROM l)),
  eo AS MATERIALIZED (SELECT row_number() OVER (ORDER BY day, match_id) AS i, match_id, x.n AS a, y.n AS b, CASE tier WHEN 'S' THEN 32.0::DOUBLE WHEN 'A' THEN 20 WHEN 'B' THEN 14 WHEN 'C' THEN 10 ELSE 24 END AS k, CAST(winner = team1 AS DOUBLE) AS s
    FROM m JOIN tn x ON x.team = team1 JOIN tn y ON y.team = team2),
  ef(i, match_id, elo1, elo2, r) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, (SELECT list(1500.0::DOUBLE) FROM tn) UNION ALL
    SELECT i, match_id, elo1, elo2, list_transform(r, lambda x, j: CASE WHEN j = a THEN x + v WHEN j = b THEN x - v ELSE x END) FROM (SELECT eo.i, eo.match_id, r[a] AS elo1, r[b] AS elo2, k * (s - 1 / (1 + pow(10, (r[b] - r[a]) / 400))) AS v, a, b, r FROM ef JOIN eo ON eo.i = ef.i + 1))"""
#: One day after another, a row for each team; the volatility by halving. Period k is the state after k days.
GLICKO_SQL = LONG_SQL + """, pd AS (SELECT day, row_number() OVER (ORDER BY day) AS period FROM (SELECT DISTINCT day FROM m)),
  gm AS MATERIALIZED (SELECT period, team1 AS team, team2 AS opp, CAST(winner = team1 AS DOUBLE) AS s, score1, score2 FROM m JOIN pd USING (day) UNION ALL SELECT period, team2, team1, CAST(winner = team2 AS DOUBLE), score1, score2 FROM m JOIN pd USING (day)),
  gf(period, team, mu, phi, sigma, played) AS (SELECT 0::BIGINT, team, 0.0::DOUBLE, 350 / 173.7178::DOUBLE, 0.06::DOUBLE, false FROM (SELECT DISTINCT team FROM l) UNION ALL
    SELECT period + 1, team, CASE WHEN i > 0 THEN mu + d * p2 ELSE mu END, least(350 / 173.7178::DOUBLE, CASE WHEN i > 0 THEN sqrt(p2) WHEN played THEN sqrt(phi * phi + sigma * sigma) ELSE phi END), CASE WHEN i > 0 THEN sn ELSE sigma END, played OR i > 0
    FROM (SELECT *, 1 / (1 / (phi * phi + sn * sn) + i) AS p2 FROM (SELECT *, exp((z.lo + z.hi) / 4) AS sn FROM (SELECT *, list_reduce(list_concat([{'lo': least(a, o), 'hi': greatest(a, o)}], list_transform(range(48), lambda q: {'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE})), lambda u, q:
      CASE WHEN exp((u.lo + u.hi) / 2) * (d2 - phi * phi - 1 / i - exp((u.lo + u.hi) / 2)) / (2 * pow(phi * phi + 1 / i + exp((u.lo + u.hi) / 2), 2)) - ((u.lo + u.hi) / 2 - a) / 0.25 >= 0 THEN {'lo': (u.lo + u.hi) / 2, 'hi': u.hi} ELSE {'lo': u.lo, 'hi': (u.lo + u.hi) / 2} END) AS z
      FROM (SELECT *, 2 * ln(sigma) AS a, d / i * d / i AS d2, CASE WHEN d / i * d / i > phi * phi + 1 / i THEN ln(d / i * d / i - phi * phi - 1 / i) ELSE 2 * ln(sigma) - 0.5 END AS o
      FROM (SELECT period, team, mu, phi, sigma, played, sum(w * g * g * e * (1 - e)) AS i, sum(w * g * (s - e)) AS d FROM (SELECT *, 1 / (1 + exp(-g * (mu - omu))) AS e FROM (
        SELECT x.*, y.mu AS omu, gm.s, WEIGHT AS w, 1 / sqrt(1 + 3 * y.phi * y.phi / pow(pi(), 2)) AS g FROM gf x LEFT JOIN gm ON gm.period = x.period + 1 AND gm.team = x.team LEFT JOIN gf y ON y.team = gm.opp)) GROUP BY ALL)))))
    WHERE period < (SELECT max(period) FROM pd))"""
GLICKO_PRE = "SELECT match_id, 1500 + 173.7178 * a.mu AS mu1, 173.7178 * a.phi AS rd1, 1500 + 173.7178 * b.mu AS mu2, 173.7178 * b.phi AS rd2 FROM m JOIN pd USING (day) JOIN gf a ON a.period = pd.period - 1 AND a.team = team1 JOIN gf b ON b.period = pd.period - 1 AND b.team = team2"
MARGIN = "CASE WHEN score1 + score2 <> 0 AND score1 <> score2 THEN ln(1 + abs(score1 - score2)) * 2.2 / (2.2 + 0.001 * 173.7178 * abs(x.mu - y.mu)) ELSE 1 END"
add("elo_pre", on_matches(ratings.elo), "SELECT match_id, elo1, elo2 FROM ef WHERE i > 0", "elo1 elo2", "RECURSIVE " + ELO_SQL)
add("elo_final", on_matches(lambda m: ratings.final_elo(m, ratings.elo(m))), "SELECT team, r[n] AS elo FROM tn, (SELECT r FROM ef ORDER BY i DESC LIMIT 1)", "elo", "RECURSIVE " + ELO_SQL)
add("glicko_pre", on_matches(ratings.glicko), GLICKO_PRE, "mu1 rd1 mu2 rd2", "RECURSIVE " + GLICKO_SQL.replace("WEIGHT", "1"))
add("glicko_final", on_matches(ratings.final_glicko), "SELECT team, 1500 + 173.7178 * mu AS mu, 173.7178 * phi AS rd, sigma FROM gf WHERE period = (SELECT max(period) FROM pd)", "mu rd sigma", "RECURSIVE " + GLICKO_SQL.replace("WEIGHT", "1"))
add("bt_pair_counts", on_matches(lambda m: ratings.pair_games(m, "map")), "SELECT map, least(team1, team2) AS lo, greatest(team1, team2) AS hi, count(*) AS games, count_if(winner = least(team1, team2)) AS lo_wins FROM m GROUP BY ALL", "", MATCH_SQL)
add("bt_theta", on_matches(ratings.bradley_terry))
add("bt_theta_by_map", on_matches(lambda m: ratings.bradley_terry_by_map(m, 4.0)))
add("glicko_margin_pre", on_matches(lambda m: ratings.glicko(m, margin=(1.0, 2.2, 0.001))), GLICKO_PRE, "mu1 rd1 mu2 rd2", "RECURSIVE " + GLICKO_SQL.replace("WEIGHT", MARGIN))
add("margin_weights", on_matches(lambda m: m.select("match_id", ratings.margin_weight(ratings.round_difference(F.col("score1"), F.col("score2")), F.col("v1") - F.col("v2")).alias("weight"))), """
    SELECT match_id, CASE WHEN score1 + score2 <> 0 AND score1 <> score2 THEN ln(1 + abs(score1 - score2)) * 2.2 / (2.2 + 0.001 * abs(v1 - v2)) ELSE 1.0 END::DOUBLE AS weight FROM m""", "weight", MATCH_SQL)

# ---------------------------------------------------------------- market
add("devig_multiplicative", on_matches(lambda m: m.select("match_id", market.devig_multiplicative(F.col("odds1"), F.col("odds2")).alias("p1"), (1 / F.col("odds1") + 1 / F.col("odds2") - 1).alias("overround"))), "SELECT match_id, (1 / odds1) / (1 / odds1 + 1 / odds2) AS p1, 1 / odds1 + 1 / odds2 - 1 AS overround FROM m", "p1 overround", MATCH_SQL)
add("devig_shin", on_matches(lambda m: m.select("match_id", market.devig_shin(F.col("odds1"), F.col("odds2")).alias("p1"))), """
    SELECT match_id, CASE WHEN z > 0 AND z < 1 THEN p / (p + q) ELSE a / s END AS p1 FROM (
      SELECT *, (sqrt(z * z + 4 * (1 - z) * a * a / s) - z) / (2 * (1 - z)) AS p, (sqrt(z * z + 4 * (1 - z) * b * b / s) - z) / (2 * (1 - z)) AS q FROM (
        SELECT match_id, a, b, a + b AS s, CASE WHEN ((a + b - 1) * ((a - b) * (a - b) - (a + b))) / ((a + b) * ((a - b) * (a - b) - 1)) BETWEEN 0 AND 0.999999 THEN ((a + b - 1) * ((a - b) * (a - b) - (a + b))) / ((a + b) * ((a - b) * (a - b) - 1)) ELSE 0 END AS z FROM (SELECT match_id, 1 / odds1 AS a, 1 / odds2 AS b FROM m)))""", "p1", MATCH_SQL)
add("devig_power_fixed_steps", on_matches(lambda m: m.select("match_id", market.devig_power("odds1", "odds2").alias("p1"))), """
    WITH RECURSIVE b AS (SELECT match_id, odds1, odds2, 0.0::DOUBLE AS lo, 20.0::DOUBLE AS hi, 0 AS i FROM m UNION ALL
      SELECT match_id, odds1, odds2, CASE WHEN pow(1 / odds1, (lo + hi) / 2) + pow(1 / odds2, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(1 / odds1, (lo + hi) / 2) + pow(1 / odds2, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM b WHERE i < 60)
    SELECT match_id, pow(1 / odds1, (lo + hi) / 2) AS p1 FROM b WHERE i = 60""", "p1", MATCH_SQL)
add("logit_pool", on_forecasts(lambda f: f.select("match_id", market.logit_pool(F.col("p"), F.col("market"), 0.3).alias("pooled"))), "SELECT match_id, 1 / (1 + exp(-(0.3 * ln(p / (1 - p)) + 0.7 * ln(market / (1 - market))))) AS pooled FROM f", "pooled", F_SQL)
add("legacy_clip", on_forecasts(lambda f: f.select("match_id", market.legacy_clip(F.col("p"), F.col("market")).alias("fused"))), "SELECT match_id, p + greatest(least(market - p, 0.03), -0.03) AS fused FROM f", "fused", F_SQL)
add("series_win_prob", on_forecasts(lambda f: f.select("match_id", market.series_probability(F.col("p"), F.col("best_of")).alias("series"))), "SELECT match_id, CASE WHEN best_of = 1 THEN p ELSE p * p * (3 - 2 * p) END AS series FROM f", "series", F_SQL)
add("score_distribution", on_forecasts(lambda f: market.score_distribution(f, "p", "match_id")), """
    SELECT match_id, '2-0' AS score, p * p AS probability FROM f UNION ALL SELECT match_id, '2-1', 2 * p * p * (1 - p) FROM f UNION ALL SELECT match_id, '1-2', 2 * p * (1 - p) * (1 - p) FROM f UNION ALL SELECT match_id, '0-2', (1 - p) * (1 - p) FROM f""", "probability", F_SQL)
add("american_odds", lambda s, d: read(s, d, "customer").select("c_custkey", keys.american_to_decimal((F.col("c_custkey") % 7 - 3) * 110).alias("odds")), "SELECT c_custkey, CASE WHEN a > 0 THEN 1 + a / 100 WHEN a < 0 THEN 1 + 100 / abs(a) END AS odds FROM (SELECT c_custkey, ((c_custkey % 7 - 3) * 110)::DOUBLE AS a FROM customer)", "odds")
add("kelly_exposure_cap", lambda s, d: market.exposure_cap(match_view(s, d).selectExpr("match_id", "day", "odds1", "0.05D + 0.9D * ((match_id * 37) % 101) / 101D as p").withColumn("stake", market.kelly(F.col("p"), F.col("odds1"))), "stake", 0.25, "day").select("match_id", "stake", "capped"), """
    SELECT match_id, stake, CASE WHEN t > 0.25 THEN stake * 0.25 / t ELSE stake END AS capped FROM (SELECT *, sum(stake) OVER (PARTITION BY day) AS t FROM (
      SELECT m.match_id, m.day, greatest((p * odds1 - 1) / (odds1 - 1), 0) * 0.5 AS stake FROM m JOIN f USING (match_id)))""", "stake capped", F_SQL)
POOL = ["click", "error", "purchase", "signup", "train"]
add("candidate_maps", on_matches(lambda m: market.candidate_maps(form.team_profile(long_form(m)), m.select("match_id", "team1", "team2"), POOL)), """
    SELECT match_id, place, map, likely / sum(likely) OVER (PARTITION BY match_id) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(likely + (w1 + w2) / 2, 9) DESC, map) AS place FROM (
      SELECT match_id, g.map, coalesce(a.winrate, 0.5) AS w1, coalesce(b.winrate, 0.5) AS w2, coalesce(a.preferred, 0) + coalesce(b.preferred, 0) + 1 - abs(coalesce(a.winrate, 0.5) - coalesce(b.winrate, 0.5)) AS likely
      FROM m CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'train']) AS map) g LEFT JOIN t a ON a.team = team1 AND a.map = g.map LEFT JOIN t b ON b.team = team2 AND b.map = g.map WHERE coalesce(a.banned, 0) + coalesce(b.banned, 0) = 0) QUALIFY place <= 3)""", "weight",
    LONG_SQL + """, t AS (SELECT team, map, winrate, CAST(greatest(4 - row_number() OVER (PARTITION BY team ORDER BY n DESC, d, i), 0) AS INT) AS preferred, CAST(row_number() OVER (PARTITION BY team ORDER BY n, map) <= 3 AS INT) AS banned FROM (
      SELECT team, map, count(*) AS n, avg(won) AS winrate, min(day) AS d, arg_min(match_id, (day, match_id)) AS i FROM l GROUP BY ALL))""")

# ---------------------------------------------------------------- splits and features
add("ratio_split", on_matches(lambda m: splits.ratio_split(m.select("match_id", "day"), 0.8, 0.1, "day", "match_id").select("match_id", "part")), """
    SELECT match_id, CASE WHEN k <= least(CAST(floor(n * 0.8) AS INT), n - greatest(1, CAST(floor(n * 0.1) AS INT)) - 1) THEN 'train' WHEN k <= least(CAST(floor(n * 0.8) AS INT), n - greatest(1, CAST(floor(n * 0.1) AS INT)) - 1) + greatest(1, CAST(floor(n * 0.1) AS INT)) THEN 'validation' ELSE 'test' END AS part
    FROM (SELECT match_id, row_number() OVER (ORDER BY day, match_id) AS k, count(*) OVER () AS n FROM m)""", "", MATCH_SQL)
add("date_split_embargo", on_matches(lambda m: splits.date_split(m, 19_738, 19_745, 2).select("match_id", "part")), "SELECT match_id, CASE WHEN day <= 19738 THEN 'train' WHEN day > 19740 AND day <= 19745 THEN 'validation' ELSE 'test' END AS part FROM m WHERE day <= 19738 OR day > 19740 AND day <= 19745 OR day > 19747", "", MATCH_SQL)
add("time_folds", on_matches(lambda m: splits.folds(m.select("match_id", "day"), 5, 3, "day", "match_id").groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("match_id").alias("lo"), F.max("match_id").alias("hi"))), """
    SELECT fold, role, count(*) AS n, min(match_id) AS lo, max(match_id) AS hi FROM (SELECT match_id, CAST(g AS INT) AS fold, CASE WHEN k <= g * z THEN 'train' WHEN k > g * z + 3 AND k <= g * z + 3 + z THEN 'validation' END AS role
      FROM (SELECT match_id, row_number() OVER (ORDER BY day, match_id) AS k, greatest(1, count(*) OVER () // 6) AS z FROM m), range(1, 6) t(g)) WHERE role IS NOT NULL GROUP BY ALL""", "", MATCH_SQL)
add("minmax_features", on_matches(lambda m: splits.scaled(m.select("match_id", "v1", "v2"), ["v1", "v2"])), "SELECT match_id, (v1 - min(v1) OVER ()) / (max(v1) OVER () - min(v1) OVER ()) AS v1, (v2 - min(v2) OVER ()) / (max(v2) OVER () - min(v2) OVER ()) AS v2 FROM m", "v1 v2", MATCH_SQL)
add("feature_variance", on_matches(lambda m: splits.feature_table(m.withColumns({"label": (F.col("winner") == F.col("team1")).cast("double"), "one": F.lit(1.0)}), ["v1", "v2", "one"], "label")), """
    SELECT 'v1' AS feature, var_pop(v1) AS variance, corr(v1, CAST(winner = team1 AS DOUBLE)) AS correlation FROM m UNION ALL SELECT 'v2', var_pop(v2), corr(v2, CAST(winner = team1 AS DOUBLE)) FROM m UNION ALL SELECT 'one', 0, 0""", "variance correlation", MATCH_SQL)
add("class_weights", on_forecasts(lambda f: splits.class_weights(f, "label")), "SELECT label, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM f GROUP BY label", "weight", F_SQL)
add("minority_interpolation", on_matches(lambda m: splits.minority_rows(m.withColumn("label", (F.col("v1") > 40).cast("int")), "label", 1, ["v1", "v2"], "day", "match_id")), """
    SELECT i, a.v1 * (1 - x) + b.v1 * x AS v1, a.v2 * (1 - x) + b.v2 * x AS v2 FROM (SELECT i, i % m AS ka, (i + 1) % m AS kb, (i + 1) / (needed + 1.0::DOUBLE) AS x
      FROM (SELECT (SELECT count(*) FROM h) AS m, (SELECT greatest(count(*), 2 * (SELECT count(*) FROM h) - count(*)) FROM m) AS dummy, abs((SELECT count(*) FROM m) - 2 * (SELECT count(*) FROM h)) AS needed), LATERAL (SELECT unnest(range(needed)) AS i)) g
    JOIN h a ON a.k = ka JOIN h b ON b.k = kb""", "v1 v2", MATCH_SQL + ", h AS (SELECT row_number() OVER (ORDER BY day, match_id) - 1 AS k, v1, v2 FROM m WHERE v1 > 40)")

# ---------------------------------------------------------------- evaluation
LOSS = "-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END"
add("metrics_by_segment", on_forecasts(lambda f: evaluate.by_segment(f, "best_of")), f"""
    SELECT coalesce(CAST(best_of AS VARCHAR), 'all') AS best_of, count(*) AS n, avg(CAST((p >= 0.5) = (label = 1) AS DOUBLE)) AS accuracy, avg({LOSS}) AS log_loss, avg(pow(p - label, 2)) AS brier FROM f GROUP BY GROUPING SETS ((best_of), ())""", "accuracy log_loss brier", F_SQL)
add("auc_rank", on_forecasts(evaluate.auc), """
    SELECT (sum(CASE WHEN label = 1 THEN r END) - max(a) * (max(a) + 1) / 2) / (max(a) * max(b)) AS auc FROM (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r, sum(label) OVER () AS a, sum(1 - label) OVER () AS b FROM f)""", "auc", F_SQL)
add("calibration_bins", on_forecasts(lambda f: evaluate.calibration_bins(f)), """
    SELECT g AS bin, count(p) AS n, avg(p) AS mean_p, avg(label) AS rate FROM range(10) t(g) LEFT JOIN f ON least(9, floor(p * 10)) = g GROUP BY g""", "mean_p rate", F_SQL)
add("brier_decomposition", on_forecasts(lambda f: evaluate.murphy(f)), """
    SELECT sum(n * pow(a - r, 2)) / sum(n) AS reliability, sum(n * pow(r - (SELECT avg(label) FROM f), 2)) / sum(n) AS resolution, (SELECT avg(label) * (1 - avg(label)) FROM f) AS uncertainty FROM (SELECT count(*) AS n, avg(p) AS a, avg(label) AS r FROM f GROUP BY least(9, floor(p * 10)))""", "reliability resolution uncertainty", F_SQL)
add("ece_equal_mass", on_forecasts(lambda f: evaluate.ece_equal_mass(f, "match_id")), """
    SELECT sum(n * g) / sum(n) AS ece, max(g) AS mce FROM (SELECT count(*) AS n, abs(avg(p) - avg(label)) AS g FROM (SELECT p, label, (row_number() OVER (ORDER BY p, label, match_id) - 1) * 10 // count(*) OVER () AS b FROM f) GROUP BY b)""", "ece mce", F_SQL)
add("bootstrap_ci", on_forecasts(lambda f: evaluate.bootstrap(f, "match_id", 50, evaluate.log_loss(F.col("p"), F.col("label")))), f"""
    SELECT avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM (SELECT sum(v * k) / sum(k) AS x FROM (
      SELECT s, v, CAST(u >= 0.36787944117144233 AS INT) + CAST(u >= 0.7357588823428847 AS INT) + CAST(u >= 0.9196986029286058 AS INT) + CAST(u >= 0.9810118431238462 AS INT) + CAST(u >= 0.9963401531726563 AS INT) + CAST(u >= 0.9994058151824183 AS INT) AS k
      FROM (SELECT s, {LOSS} AS v, CAST(('0x' || substr(md5(s || '|' || match_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM f, range(1, 51) t(s))) GROUP BY s)""", "mean std low high", F_SQL)
add("diebold_mariano_stat", on_forecasts(lambda f: evaluate.diebold_mariano(f, "match_id")), """
    SELECT count(*) AS n, avg(d) AS mean_difference, avg(d) / sqrt(var_pop(d) / count(*)) * sqrt((count(*) - 1.0::DOUBLE) / count(*)) AS statistic FROM (SELECT pow(p - label, 2) - pow(p2 - label, 2) AS d FROM f)""", "mean_difference statistic", F_SQL)

# ---------------------------------------------------------------- backtest
add("threshold_candidates", on_forecasts(lambda f: backtest.thresholds(f)), """
    SELECT t AS threshold, count_if(abs(p - 0.5) >= t) AS picks, count_if(abs(p - 0.5) >= t AND (p >= 0.5) = (label = 1)) AS correct FROM f, (SELECT unnest([0.0, 0.02, 0.05, 0.08, 0.10, 0.12, 0.15]::DOUBLE[]) AS t) GROUP BY t""", "threshold", F_SQL)
add("bo1_margin_candidates", on_forecasts(lambda f: backtest.bo1_policy(f, 0.02, 0.1)), """
    SELECT best_of, count(*) AS n, count_if(k) AS picks, count_if(k AND (p >= 0.5) = (label = 1)) AS correct FROM (SELECT *, abs(p - 0.5) >= CASE WHEN best_of = 1 THEN 0.1::DOUBLE ELSE 0.02::DOUBLE END AS k FROM f) GROUP BY best_of""", "", F_SQL)
add("avoid_reasons", on_forecasts(lambda f: backtest.avoid_reasons(f, 0.05)), """
    SELECT CASE WHEN abs(p - 0.5) <= 0.05::DOUBLE THEN 'low_confidence' WHEN form_diff * (p - 0.5) < 0 AND form_confidence >= 0.4 THEN 'form_counter_signal' WHEN greatest(p, 1 - p) <= 0.55::DOUBLE THEN 'avoid' ELSE 'picked' END AS reason, count(*) AS n, count_if((p >= 0.5) = (label = 1)) AS correct FROM f GROUP BY reason""", "", F_SQL)
add("favorite_upsets", on_forecasts(lambda f: backtest.favourite_upsets(f)), """
    SELECT 'model' AS kind, count(*) AS n, count_if((p >= 0.5) <> (label = 1)) AS upsets FROM f WHERE greatest(p, 1 - p) >= 0.55 UNION ALL SELECT 'market', count(*), count_if((market >= 0.5) <> (label = 1)) FROM f WHERE greatest(market, 1 - market) >= 0.55
    UNION ALL SELECT 'agreement', count(*), count_if((p >= 0.5) <> (label = 1)) FROM f WHERE greatest(p, 1 - p) >= 0.55 AND greatest(market, 1 - market) >= 0.55 AND (p >= 0.5) = (market >= 0.5)""", "", F_SQL)
add("policy_topk", on_forecasts(lambda f: backtest.top_by_policy(f, "map", "p", "match_id", 5).select("map", "place", "match_id")), "SELECT map, k AS place, match_id FROM (SELECT map, match_id, row_number() OVER (PARTITION BY map ORDER BY p DESC, match_id) AS k FROM f) WHERE k <= 5", "", F_SQL)
add("composite_score", on_forecasts(lambda f: backtest.composite(f, "map", {"p": 0.3, "market": 0.2, "p2": 0.5}).select("match_id", "composite")), """
    SELECT match_id, 0.3 * (p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w) + 0.2 * (market - min(market) OVER w) / (max(market) OVER w - min(market) OVER w) + 0.5 * (p2 - min(p2) OVER w) / (max(p2) OVER w - min(p2) OVER w) AS composite FROM f WINDOW w AS (PARTITION BY map)""", "composite", F_SQL)
add("suite_pass_rate", on_forecasts(lambda f: backtest.suite_pass_rate(f.select(F.expr("match_id div 10").alias("case_id"), backtest.correct().alias("hit")))), """
    SELECT count(*) AS n_cases, count_if(h >= 5) AS passed, avg(CAST(h >= 5 AS DOUBLE)) AS pass_rate FROM (SELECT count_if((p >= 0.5) = (label = 1)) AS h FROM f GROUP BY match_id // 10)""", "pass_rate", F_SQL)

# ---------------------------------------------------------------- swiss
add("standings", on_matches(swiss.standings), "SELECT team, CAST(sum(won) AS BIGINT) AS wins, CAST(count(*) - sum(won) AS BIGINT) AS losses FROM l GROUP BY team", "", LONG_SQL)
add("buchholz", on_matches(swiss.buchholz), "SELECT l.team, CAST(sum(net) AS BIGINT) AS buchholz FROM l JOIN (SELECT team AS o, 2 * sum(won) - count(*) AS net FROM l GROUP BY team) ON o = opp GROUP BY l.team", "", LONG_SQL)
add("record_status", on_matches(lambda m: swiss.standings(in_stages(m), "stage").withColumn("status", swiss.record_status())), "SELECT stage, team, wins, losses, CASE WHEN wins >= 3 THEN 'advanced' WHEN losses >= 3 THEN 'eliminated' ELSE 'alive' END AS status FROM st", "", STAGE_SQL)
add("checkpoint_status", on_matches(lambda m: stage_picks(m).withColumn("state", swiss.checkpoint()).select("stage", "team", "category", "state")), f"SELECT stage, team, category, {STATE} AS state FROM k", "", PICK_SQL)


def _field(m: DataFrame) -> list[float]:
    """Win shares of the sixteen teams with the most matches: the entrants of a stage, the best first."""
    busiest = swiss.standings(m).withColumn("n", F.col("wins") + F.col("losses")).orderBy(F.desc("n"), "team").limit(16)
    return sorted((r[0] for r in busiest.select(F.col("wins") / F.col("n")).collect()), reverse=True)


add("swiss_mc", lambda s, d: swiss.outcome_shares(swiss.simulate(s, _field(match_view(s, d)), 4_000)))


# ---------------------------------------------------------------- store and sources
def _versions(m: DataFrame) -> DataFrame:
    return m.select("team1", "team2", "day", "map", "best_of", F.when(F.col("match_id") % 2 == 0, F.concat(F.lit("U"), F.col("match_id") % 1000)).alias("url"), (F.col("match_id") % 3).alias("batch"), F.col("match_id").alias("seq"))


add("upsert_last_wins", on_matches(lambda m: store.upsert(_versions(m)).select("identity", "batch", "seq")), """
    SELECT identity, max(batch) AS batch, arg_max(seq, (batch, seq)) AS seq FROM (SELECT CASE WHEN match_id % 2 = 0 THEN 'url::u' || (match_id % 1000) ELSE concat_ws('::', 'match', day, least(team1, team2), greatest(team1, team2), map, best_of) END AS identity, match_id % 3 AS batch, match_id AS seq
      FROM m) GROUP BY identity""", "", MATCH_SQL)
add("dataset_manifest", on_matches(store.manifest), "SELECT count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day, (SELECT count(DISTINCT team) FROM l) AS n_teams FROM m", "", LONG_SQL)
add("page_links", lambda s, d: pages.links(read(s, d, "pages")), "SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n_links, md5(url) AS url_md5 FROM pages")
add("event_props", lambda s, d: pages.props(read(s, d, "events"), "k long").select("event_id", F.col("props.k").alias("k")), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")

# ---------------------------------------------------------------- features, models, reports
add("feature_differences", on_matches(lambda m: features.differences(m, ["v", "odds", "score"])), "SELECT match_id, v1 - v2 AS v_diff, odds1 - odds2 AS odds_diff, (score1 - score2)::DOUBLE AS score_diff FROM m", "v_diff odds_diff score_diff", MATCH_SQL)
add("aligned_rows", on_matches(lambda m: features.swapped(m.selectExpr("match_id", "team1", "team2", "odds1", "odds2", "1 / odds1 as p"), ["team", "odds"], F.col("team1") > F.col("team2"))), """
    SELECT match_id, least(team1, team2) AS team1, greatest(team1, team2) AS team2, CASE WHEN team1 > team2 THEN odds2 ELSE odds1 END AS odds1, CASE WHEN team1 > team2 THEN odds1 ELSE odds2 END AS odds2, CASE WHEN team1 > team2 THEN 1 - 1 / odds1 ELSE 1 / odds1 END AS p FROM m""", "odds1 odds2 p", MATCH_SQL)
add("veto_features", on_matches(lambda m: m.withColumns({"a": keys.split_list(F.lit("click|view;De_error")), "b": keys.split_list(F.concat(F.col("map"), F.lit(",view")))}).select("match_id", *(v.alias(k) for k, v in features.veto_features(F.col("a"), F.col("b"), F.col("b"), F.col("a"), F.col("map"), F.col("match_id") % 2 == 0).items()))), """
    SELECT match_id, CASE WHEN e THEN 5.0::DOUBLE ELSE 0 END AS n_bans, CASE WHEN e THEN len(list_distinct(list_intersect(a, b)))::DOUBLE ELSE 0 END AS shared_bans, CASE WHEN e THEN 1.0::DOUBLE ELSE 0 END AS picked, CASE WHEN e THEN 1.0::DOUBLE - list_contains(a, map)::INT ELSE 0 END AS own_pick
    FROM (SELECT match_id, map, match_id % 2 = 0 AS e, ['click', 'view', 'error'] AS a, [map, 'view'] AS b FROM m)""", "n_bans shared_bans picked own_pick", MATCH_SQL)
add("brier_skill", on_forecasts(lambda f: evaluate.brier_skill(f, F.col("market"))), """
    SELECT CASE WHEN b = 0 THEN 0 ELSE 1 - a / b END AS skill, CASE WHEN r * (1 - r) = 0 THEN 0 ELSE 1 - a / (r * (1 - r)) END AS over_rate FROM (SELECT avg((p - label) * (p - label)) AS a, avg((market - label) * (market - label)) AS b, avg(label::DOUBLE) AS r FROM f)""", "skill over_rate", F_SQL)
add("kelly_audit", on_forecasts(lambda f: market.kelly_audit(f, "p", F.lit(1.0) / F.col("market"), "match_id")), """
    SELECT match_id, p, o AS odds, (o - 1) * p - (1 - p) AS edge, greatest((p * o - 1) / (o - 1), 0) AS raw_kelly, 0.5::DOUBLE AS fraction, 0.5 * greatest((p * o - 1) / (o - 1), 0) AS fractional_kelly FROM (SELECT match_id, p, 1 / market AS o FROM f)""", "p odds edge raw_kelly fraction fractional_kelly", F_SQL)
add("linear_blend", on_forecasts(lambda f: f.select("match_id", market.linear_blend(F.col("p"), F.col("market"), 0.35).alias("fused"))), "SELECT match_id, least(greatest(0.65 * p + 0.35 * market, 1e-6), 1 - 1e-6) AS fused FROM f", "fused", F_SQL)
add("probability_bins", on_forecasts(lambda f: f.groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("long").alias("bin")).agg(F.count("*").alias("n"))), "SELECT CAST(least(9, floor(p * 10)) AS BIGINT) AS bin, count(*) AS n FROM f GROUP BY bin", "", F_SQL)
add("market_fusion_report", on_forecasts(lambda f: f.withColumn("fused", market.logit_pool(F.col("p"), F.col("market"), 0.3)).agg(*(F.avg(evaluate.log_loss(F.col(c), F.col("label"))).alias(c) for c in ("p", "market", "fused")), F.count("*").alias("n"))), """
    SELECT avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) AS p, avg(-CASE WHEN label = 1 THEN ln(market) ELSE ln(1 - market) END) AS market, avg(-CASE WHEN label = 1 THEN ln(u) ELSE ln(1 - u) END) AS fused, count(*) AS n
    FROM (SELECT *, 1 / (1 + exp(-(0.3 * ln(p / (1 - p)) + 0.7 * ln(market / (1 - market))))) AS u FROM f)""", "p market fused", F_SQL)
add("profit_loss", on_matches(lambda m: m.agg(F.sum(F.when(F.col("winner") == F.col("team1"), F.col("odds1") - 1).otherwise(F.lit(-1.0))).alias("profit"), F.count("*").alias("bets"))), "SELECT sum(CASE WHEN winner = team1 THEN odds1 - 1 ELSE -1 END) AS profit, count(*) AS bets FROM m", "profit", MATCH_SQL)
def _shares_of_stage(m: DataFrame) -> DataFrame:
    return swiss.standings(in_stages(m), "stage").select("stage", "team", (F.col("wins") / (F.col("wins") + F.col("losses"))).alias("x"))


def _met(m: DataFrame) -> DataFrame:
    """Pairs that meet in a stage, with the probability that their shares of wins give."""
    pairs = in_stages(m).select("stage", F.least("team1", "team2").alias("a"), F.greatest("team1", "team2").alias("b")).distinct()
    x, y = (_shares_of_stage(m).select("stage", F.col("team").alias(k), F.col("x").alias(f"x{k}")) for k in "ab")
    return pairs.join(x, ["stage", "a"]).join(y, ["stage", "b"]).select("stage", "a", "b", swiss.edge_probability(F.col("xa"), F.col("xb")).alias("p"))


add("pair_probability_grid", on_matches(_met), """
    SELECT q.stage, a, b, least(greatest(0.5 + (x.w - y.w) * 0.28 / 0.35, 0.06), 0.94) AS p FROM (SELECT DISTINCT match_id // 60 AS stage, least(team1, team2) AS a, greatest(team1, team2) AS b FROM m) q
    JOIN sw x ON x.stage = q.stage AND x.team = a JOIN sw y ON y.stage = q.stage AND y.team = b""", "p", STAGE_SQL + ", sw AS (SELECT stage, team, wins / (wins + losses)::DOUBLE AS w FROM st)")
add("match_types", on_matches(lambda m: m.selectExpr("match_id", "match_id % 4 as wins1", "match_id % 3 as wins2", "(match_id div 5) % 3 as losses1", "(match_id div 7) % 3 as losses2").select("match_id", swiss.match_type().alias("kind"))), """
    SELECT match_id, CASE WHEN match_id % 4 = 2 AND match_id % 3 = 2 THEN 'advancement' WHEN (match_id // 5) % 3 = 2 AND (match_id // 7) % 3 = 2 THEN 'elimination' ELSE 'standard' END AS kind FROM m""", "", MATCH_SQL)
add("decision_summary", on_forecasts(lambda f: f.groupBy(backtest.pick(0.05).alias("pick")).agg(F.count("*").alias("n"), F.avg(backtest.margin()).alias("margin"))), "SELECT CASE WHEN greatest(p, 1 - p) <= 0.55::DOUBLE THEN 'avoid' WHEN p > 0.5 THEN 'team1' ELSE 'team2' END AS pick, count(*) AS n, avg(abs(p - 0.5)) AS margin FROM f GROUP BY pick", "margin", F_SQL)
add("forecast_decisions", forecast.decisions)


# ---------------------------------------------------------------- readiness and tickets
add("readiness_audit", on_matches(lambda m: readiness.audit(m, 400, 10, ("map", "tier"), 19_745)), """
    SELECT 'rows' AS name, CAST(count(*) >= 400 AS INT) AS passed, CAST(count(*) AS VARCHAR) AS detail FROM m UNION ALL SELECT 'teams', CAST(count(DISTINCT team) >= 10 AS INT), CAST(count(DISTINCT team) AS VARCHAR) FROM l
    UNION ALL SELECT 'winners', 1, '0' UNION ALL SELECT 'field_map', 1, '0' UNION ALL SELECT 'field_tier', 1, '0' UNION ALL SELECT 'recent', CAST(max(day) >= 19745 AS INT), CAST(max(day) AS VARCHAR) FROM m""", "", LONG_SQL)
