"""JSON payloads of a results service: one parse, two projections (matches and maps)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEAM = "struct<id: string, disp_name: string, name: string, team_name: string, rank: string, v_rank: string>"
BOUT = "struct<bout_num: string, map_name: string, t1_score: string, t2_score: string, result: string, status: string>"
ITEM = (
    f"struct<mc_info: struct<id: string, t1_info: {TEAM}, t2_info: {TEAM}, plan_ts: string, format: string, round_name: string, tt_stage: string, grade: string>, "
    f"state: struct<t1_score: string, t2_score: string, t1_odds: string, t2_odds: string, status: string, bout_states: array<{BOUT}>>, tt_info: struct<id: string, disp_name: string, grade: string, grade_label: string, status: string>>"
)
PAYLOAD = f"data struct<matches: array<{ITEM}>, list: array<{ITEM}>, items: array<{ITEM}>>"
# fixed values: codes of the service
STATUS = {"0": "upcoming", "1": "live", "2": "completed", "3": "cancelled"}
BEST_OF = {"1": 1, "3": 3, "5": 5, "0": 1, "2": 3, "4": 5}


def _text(*c: str) -> Column:
    return F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in c))


def _code(c: Column, codes: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[c]


def status(c: str) -> Column:
    return F.coalesce(_code(F.col(c), STATUS), F.col(c))


def best_of(code: str, n_maps: Column) -> Column:
    """By code, else the number of maps, else null."""
    return F.coalesce(_code(F.col(code).try_cast("long").cast("string"), BEST_OF).cast("long"), F.when(n_maps > 0, n_maps.cast("long")))


def parsed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row a match with an id and two named teams; what is not JSON gives none."""
    data = F.from_json(column, PAYLOAD).getField("data")
    items = F.coalesce(*(F.when(F.size(data[c]) > 0, data[c]) for c in ("matches", "list", "items")))
    rows = payloads.select(F.explode(items).alias("i")).select("i.mc_info", "i.state", "i.tt_info")
    names = {f"team{n}": _text(f"mc_info.t{n}_info.disp_name", f"mc_info.t{n}_info.name", f"mc_info.t{n}_info.team_name") for n in (1, 2)}
    return rows.select("*", _text("mc_info.id").alias("match_id"), *(v.alias(k) for k, v in names.items())).filter("match_id is not null and team1 is not null and team2 is not null")


def _winner(a: Column, b: Column) -> Column:
    return F.when(a > b, F.col("team1")).when(b > a, F.col("team2"))


def matches(rows: DataFrame, offset_hours: int = 8) -> DataFrame:
    """The date is that of the service's clock, ``offset_hours`` ahead of UTC. A tie or a missing score leaves the winner null."""
    a, b = (F.col(f"state.t{n}_score").try_cast("double").cast("long") for n in (1, 2))
    n = F.coalesce(F.size("state.bout_states"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    day = F.date_from_unix_date(F.floor((F.col("mc_info.plan_ts").try_cast("long") + offset_hours * 3600) / 86_400).cast("int"))
    return rows.select(
        "match_id", day.alias("date"), _text("tt_info.disp_name").alias("event"), F.coalesce(_text("tt_info.grade"), _text("mc_info.grade")).alias("grade"), _text("mc_info.tt_stage").alias("stage"), _text("mc_info.round_name").alias("round"),
        best_of("mc_info.format", n).alias("best_of"), status("state.status").alias("status"), "team1", "team2", a.alias("score1"), b.alias("score2"), _winner(a, b).alias("winner"),
        *(F.col(f"state.t{k}_odds").try_cast("double").alias(f"odds{k}") for k in (1, 2)), n.cast("long").alias("n_maps"),
    )


def maps(rows: DataFrame) -> DataFrame:
    """A row a map. Scores decide; the result flag only where they are missing or equal."""
    each = rows.select("match_id", "team1", "team2", F.explode("state.bout_states").alias("b"))
    a, b = (F.col(f"b.t{n}_score").try_cast("double").cast("long") for n in (1, 2))
    flag = F.when(F.col("b.result") == "t1", F.col("team1")).when(F.col("b.result") == "t2", F.col("team2"))
    return each.select("match_id", F.col("b.bout_num").try_cast("long").alias("bout_num"), F.col("b.map_name").alias("map"), a.alias("score1"), b.alias("score2"), F.coalesce(_winner(a, b), flag).alias("winner"), status("b.status").alias("status"))


def page_token(rows: DataFrame) -> DataFrame:
    """Where the page before these matches ends: the earliest start and the ids at it."""
    at = rows.select(F.col("mc_info.plan_ts").try_cast("long").alias("ts"), "match_id").filter("ts is not null")
    return at.groupBy("ts").agg(F.sort_array(F.collect_set("match_id")).alias("ids")).agg(F.min_by(F.struct("ts", "ids"), "ts").alias("t")).select("t.*").filter("ts is not null")
