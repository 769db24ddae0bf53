"""Features of a match row: differences that change sign when the two sides are exchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differences(rows: DataFrame, fields: list[str], key: str = "match_id") -> DataFrame:
    """team1's value less team2's; a missing value is 0."""
    side = lambda n, c: F.coalesce(F.col(f"{c}{n}"), F.lit(0.0))
    return rows.select(key, *((side(1, c) - side(2, c)).alias(f"{c}_diff") for c in fields))


def swapped(rows: DataFrame, fields: list[str], when: Column) -> DataFrame:
    """Both sides' columns exchanged where ``when`` holds; probabilities turned to the other side."""
    out = {}
    for c in fields:
        out[f"{c}1"] = F.when(when, F.col(f"{c}2")).otherwise(F.col(f"{c}1"))
        out[f"{c}2"] = F.when(when, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    if "p" in rows.columns:
        out["p"] = F.when(when, 1 - F.col("p")).otherwise(F.col("p"))
    return rows.select(*(out.get(c, F.col(c)).alias(c) for c in rows.columns))


def veto_features(bans1: Column, bans2: Column, picks1: Column, picks2: Column, played: Column, applied: Column) -> dict[str, Column]:
    """The same for both orientations but for the last; all 0 unless a veto was applied."""
    zero = lambda c: F.when(applied, c.cast("double")).otherwise(F.lit(0.0))
    return {
        "n_bans": zero(F.size(bans1) + F.size(bans2)), "shared_bans": zero(F.size(F.array_intersect(bans1, bans2))),
        "picked": zero(F.array_contains(picks1, played) | F.array_contains(picks2, played)), "own_pick": zero(F.array_contains(picks1, played).cast("int") - F.array_contains(picks2, played).cast("int")),
    }
