"""The feature table: one row of numbers for each match, from whatever of the input columns is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swissline.functions import keys
from swissline.operators import market
from swissline.operators.splits import category_codes

# fixed values: feature, field of both teams (team1_<field>, team2_<field>), value where it is missing; team1 less team2
DIFFERENCES = (
    ("elo_diff", "elo", 1500.0),
    ("rmr_points_diff", "rmr_points", 0.0),
    ("matches_30d_diff", "matches_30d", 0.0),
    ("recent_winrate_5_diff", "recent_winrate_5", 0.5),
    ("recent_winrate_10_diff", "recent_winrate_10", 0.5),
    ("bo1_winrate_diff", "bo1_winrate_6m", 0.5),
    ("bo3_winrate_diff", "bo3_winrate_6m", 0.5),
    ("map_winrate_diff", "map_winrate", 0.5),
    ("rating_diff", "rating", 1.0),
    ("kd_diff", "kd", 1.0),
    ("opening_success_diff", "opening_success", 0.5),
    ("clutch_winrate_diff", "clutch_winrate", 0.5),
    ("star_rating_diff", "star_rating", 1.0),
    ("substitute_flag_diff", "substitute_flag", 0.0),
    ("player_sample_diff", "player_sample", 0.0),
    ("player_form_score_diff", "player_form_score", 0.0),
    ("player_form_trend_diff", "player_form_trend", 0.0),
    ("player_sample_confidence_diff", "player_sample_confidence", 0.0),
    ("current_streak_diff", "current_streak", 0.0),
)
# fixed values: the same, team2 less team1, as a lower value is the better one
REVERSED = (("rank_diff", "rank", 80.0), ("major_best_placement_diff", "major_best_placement", 32.0))
# fixed values: feature, column of the match, value where it is missing
OF_MATCH = (
    ("h2h_team1_winrate", "h2h_team1_winrate", 0.5),
    ("bt_strength_diff", "bt_strength_diff", 0.0),
    ("bt_map_strength_diff", "bt_map_strength_diff", 0.0),
    ("odds_provider_count", "odds_provider_count", 0.0),
    ("swiss_round", "swiss_round", 1.0),
    ("team1_wins", "team1_wins", 0.0),
    ("team1_losses", "team1_losses", 0.0),
    ("team2_wins", "team2_wins", 0.0),
    ("team2_losses", "team2_losses", 0.0),
)
# fixed values: the maps that get a column of their own
MAPS = ("mirage", "inferno", "ancient", "anubis", "nuke", "overpass", "train")
# fixed values: columns of names that become codes, beside the teams
NAMED = {"event": "event_code", "event_tier": "event_tier_code", "version_tag": "version_tag_code"}


def coded(rows: DataFrame, *order: str) -> DataFrame:
    """Codes of names by first appearance in ``order``, both teams counted together; a missing name is "unknown"."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    there = [c for c in NAMED if c in rows.columns]
    out = rows.withColumns({f"_{c}": name(c) for c in ("team1", "team2", *there)})
    sides = out.select(*order, F.posexplode(F.array("_team1", "_team2")).alias("_side", "_name"))
    teams = category_codes(sides, "_name", *order, "_side")
    tables = {"team1": ("team1_code", teams), "team2": ("team2_code", teams)}
    tables |= {c: (NAMED[c], category_codes(out.select(*order, F.col(f"_{c}").alias("_name")), "_name", *order)) for c in there}
    for c, (code, table) in tables.items():
        out = out.join(table.select(F.col("_name").alias(f"_{c}"), F.col("code").cast("double").alias(code)), f"_{c}").drop(f"_{c}")
    return out.withColumns({NAMED[c]: F.lit(0.0) for c in NAMED if c not in there})


def match_features(rows: DataFrame, order: tuple[str, ...] = ("day", "match_id"), key: str = "match_id", unverified: bool = False, maps: tuple[str, ...] = MAPS) -> DataFrame:
    """Features of each match; ``unverified`` adds those left out by default. Missing columns, nulls and texts that are no numbers take the neutral value.

    The vetoes come as ``joins.merge_veto`` gives them, split into lists: veto_applied, veto_confidence, bans1, bans2, picks1, picks2.
    """
    have = set(rows.columns)

    def value(c: str, missing: float | None) -> Column:
        return keys.number(F.col(c), missing) if c in have else F.lit(missing).cast("double")

    def team(n: int, field: str, missing: float | None) -> Column:
        return value(f"team{n}_{field}", missing)

    names = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")
    truth = lambda c: keys.truthy(F.col(c), "features") if c in have else F.lit(False)
    flag = lambda on: F.coalesce(on, F.lit(False)).cast("double")
    needed = lambda n, what: F.greatest(F.lit(0.0), 3 - team(n, what, 0.0))
    applied = truth("veto_applied")
    veto = lambda c: F.when(applied, c.cast("double")).otherwise(F.lit(0.0))
    best_of = F.floor(value("best_of", 1.0))
    played = keys.map_key(F.col("map")) if "map" in have else F.lit("unknown")
    implied = market.devig_multiplicative(value("odds_team1", 2.0), value("odds_team2", 2.0))

    out = {f: team(1, c, d) - team(2, c, d) for f, c, d in DIFFERENCES}
    out |= {f: team(2, c, d) - team(1, c, d) for f, c, d in REVERSED}
    out |= {f: value(c, d) for f, c, d in OF_MATCH}
    out |= {
        "odds_implied_diff": 2 * implied - 1,
        "glicko_diff": F.coalesce(value("glicko_diff", None), team(1, "glicko_pre", None) - team(2, "glicko_pre", None), F.lit(0.0)),
        "bp_applied": flag(applied), "odds_is_proxy": flag(truth("market_signal_proxy")), "is_bo1": flag(best_of == 1), "is_bo3": flag(best_of == 3),
        "swiss_score_diff": (team(1, "wins", 0.0) - team(1, "losses", 0.0)) - (team(2, "wins", 0.0) - team(2, "losses", 0.0)),
        "wins_needed_to_advance_diff": needed(2, "wins") - needed(1, "wins"),
        "losses_until_elimination_diff": needed(1, "losses") - needed(2, "losses"),
    }
    out |= {f"map_{m}": flag(played == m) for m in maps}
    if unverified:
        grades = [team(n, "fivee_6m_avg_event_grade", 0.0) for n in (1, 2)]
        out |= {
            "glicko_rd_sum": F.coalesce(value("glicko_rd_sum", None), team(1, "rd_pre", None) + team(2, "rd_pre", None), F.lit(700.0)),
            "event_grade_sum": value("event_grade", 0.0), "team_event_grade_sum": grades[0] + grades[1], "team_event_grade_diff": grades[0] - grades[1],
            "bp_confidence": veto(value("veto_confidence", 0.0)), "bp_total_bans": veto(F.size(names("bans1")) + F.size(names("bans2"))),
            "bp_ban_overlap": veto(F.size(F.array_intersect(names("bans1"), names("bans2")))), "bp_total_picks": veto(F.size(names("picks1")) + F.size(names("picks2"))),
            "odds_overround": value("overround", 0.0), "odds_devig_z": value("devig_z", 0.0),
        }
    return coded(rows, *order).select(key, *(v.alias(k) for k, v in out.items()), "team1_code", "team2_code", *NAMED.values())
