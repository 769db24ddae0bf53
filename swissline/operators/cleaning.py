"""Cleaning of match history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: statuses that drop a row, tiers that keep it, and name parts of second and temporary teams
BAD_STATUSES = ("forfeit", "forfeited", "walkover", "cancelled", "canceled", "postponed", "abandoned", "default", "void", "bye")
VALID_TIERS = ("S", "A")
SECONDARY = "academy|junior|jr|youth|reserve|secondary|b team"
TEMPORARY = "mix|stack|pickup|tbd|placeholder|temp|showmatch|all-star|all star"


def quality_filter(matches: DataFrame, reference_day: int, max_age_days: int = 90, tiers: tuple[str, ...] = VALID_TIERS) -> DataFrame:
    """No upper bound on the day: rows after the reference stay. Teams are matched by name part."""
    fine = (F.col("day") >= reference_day - max_age_days) & F.upper(F.trim("tier")).isin(*tiers) & ~F.coalesce(F.lower(F.trim("status")).isin(*BAD_STATUSES), F.lit(False))
    for side in ("team1", "team2"):
        fine &= ~F.lower(F.col(side).cast("string")).rlike(f"{SECONDARY}|{TEMPORARY}")
    return matches.filter(fine)


def drop_outliers(rows: DataFrame, fields: list[str], sigmas: float = 3.0) -> DataFrame:
    """A row goes if a field is over ``sigmas`` population deviations from the mean of all other rows. Sums of one pass; no sort."""
    sums = rows.agg(*(f(x).alias(f"_{k}_{c}") for c in fields for k, f, x in (("n", F.count, F.col(c)), ("s", F.sum, F.col(c)), ("q", F.sum, F.col(c) * F.col(c)))))
    out, keep = rows.join(F.broadcast(sums)), F.lit(True)  # the sums are one row
    for c in fields:
        n, x = F.col(f"_n_{c}") - 1, F.col(c)
        mean = (F.col(f"_s_{c}") - x) / n
        var = (F.col(f"_q_{c}") - x * x) / n - mean * mean
        keep &= F.coalesce(~((n >= 3) & (var > 0) & (F.abs(x - mean) > sigmas * F.sqrt(F.greatest(var, F.lit(0.0))))), F.lit(True))
    return out.filter(keep).select(*rows.columns)


def scope_counts(matches: DataFrame, reference_day: int, max_age_days: int = 90) -> DataFrame:
    old, bad = F.col("day") < reference_day - max_age_days, F.lower("status").isin(*BAD_STATUSES)
    return matches.agg(
        F.count("*").alias("n_rows"), F.count_if(old).alias("n_old"), F.count_if(~F.col("tier").isin(*VALID_TIERS)).alias("n_low_tier"),
        F.count_if(bad).alias("n_bad_status"), F.count_if(F.col("day") > reference_day).alias("n_future"), F.count_if(F.col("winner").isNull()).alias("n_no_winner"),
    )


def missing_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Name of each field that any row lacks."""
    gaps = rows.agg(*(F.max((F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("int")).alias(c) for c in fields))
    return gaps.unpivot([], fields, "field", "lacks").select("field", F.col("lacks").cast("int").alias("lacks"))


def in_dates(rows: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose text date lies within the bounds, both included; a text that is no date goes."""
    day = F.col(column).cast("string").try_cast("date")
    kept = rows.filter(day.isNotNull())
    for on in ([day >= F.lit(start).cast("date")] if start else []) + ([day <= F.lit(end).cast("date")] if end else []):
        kept = kept.filter(on)
    return kept
