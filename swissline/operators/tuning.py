"""Comparison of candidates: folds summed up, and the choice by validation rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swissline.operators.evaluate import by_segment, log_loss


def rolling_summary(rows: DataFrame, fold: str = "fold") -> DataFrame:
    """Means of the folds' metrics, each fold counted alike, and the worst fold."""
    each = by_segment(rows, fold).filter(F.col(fold) != "all")
    return each.agg(
        F.count("*").alias("folds"), *(F.avg(c).alias(c) for c in ("accuracy", "log_loss", "brier")), F.min("accuracy").alias("worst_accuracy"), F.max("log_loss").alias("worst_log_loss")
    )


def candidate_choice(rows: DataFrame, candidates: list[str], part: str = "part") -> DataFrame:
    """Log loss of each candidate's column on validation and test rows, in one aggregation. ``chosen`` looks at validation only; ``test_best`` is for the report. Ties go by name."""
    loss = lambda c, k: F.avg(F.when(F.col(part) == k, log_loss(F.col(c), F.col("label")))).alias(f"{c}_{k}")
    one = rows.agg(*(loss(c, k) for c in candidates for k in ("validation", "test")))
    line = lambda c: F.struct(F.lit(c).alias("candidate"), F.col(f"{c}_validation").alias("validation"), F.col(f"{c}_test").alias("test"))
    first = lambda c: (F.row_number().over(Window.orderBy(F.col(c).asc_nulls_last(), "candidate")) == 1).cast("int")
    return one.select(F.inline(F.array(*map(line, candidates)))).withColumns({"chosen": first("validation"), "test_best": first("test")})
