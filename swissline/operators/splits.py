"""Time-ordered splits, scaling, selection and balance of training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_ranges(rows: DataFrame, *order: str, most: int = 512, each: int = 20) -> DataFrame:
    """``rows`` with ``_part``, the number of a range of the order. The bounds come from ``each`` rows a range, drawn at random, so a frequent value
    counts as often as it stands there; they are collected once, so whatever uses the numbers sees the same ranges, also when a lost task runs again."""
    n = min(most, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = sorted(rows.select(*order).orderBy(F.rand(17)).limit(each * n).collect(), key=lambda r: [(x is not None, x) for x in r])
    bounds = list(dict.fromkeys(drawn[i] for i in range(each, len(drawn), each)))
    if not bounds:
        return rows.withColumn("_part", F.lit(0))
    kinds = {c: rows.schema[c].dataType for c in order}
    known = F.array(*(F.struct(*(F.lit(x).cast(kinds[c]).alias(c) for c, x in zip(order, b))) for b in bounds))
    return rows.withColumn("_part", F.size(F.filter(known, lambda b: b < F.struct(*order))))


def before_ranges(ranges: DataFrame, size: Column) -> Column:
    """The sum of ``size`` over all ranges before that of a row; a number for each range is collected."""
    sums, before, total = {r[0]: r[1] for r in ranges.groupBy("_part").agg(size).collect()}, {}, 0
    for k in sorted(sums):
        before[k], total = total, total + sums[k]
    return F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("_part")) if before else F.lit(0)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Place of each row in a total order without one task for all: places within ranges plus what stands before them."""
    ranges = in_ranges(rows, *order)
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranges.withColumn("place", local.cast("long") + before_ranges(ranges, F.count("*"))).drop("_part")


def ratio_split(rows: DataFrame, train: float = 0.8, validation: float = 0.1, *order: str) -> DataFrame:
    n = rows.count()
    a, b = int(n * train), int(n * validation)
    if n >= 3:
        b = max(1, b)
        a = min(a, n - b - 1)
    return ranked(rows, *order).withColumn("part", F.when(F.col("place") <= a, "train").when(F.col("place") <= a + b, "validation").otherwise("test"))


def date_split(rows: DataFrame, train_end: int, validation_end: int, embargo: int = 0) -> DataFrame:
    d = F.col("day")
    return rows.withColumn("part", F.when(d <= train_end, "train").when((d > train_end + embargo) & (d <= validation_end), "validation").when(d > validation_end + embargo, "test")).filter("part is not null")


def folds(rows: DataFrame, n_folds: int = 5, embargo: int = 0, *order: str) -> DataFrame:
    """Expanding folds of n div (folds + 1) rows: fold, role and row."""
    size = max(1, rows.count() // (n_folds + 1))
    r = ranked(rows, *order).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_folds))))
    end = F.col("fold") * size
    return r.withColumn("role", F.when(F.col("place") <= end, "train").when((F.col("place") > end + embargo) & (F.col("place") <= end + embargo + size), "validation")).filter("role is not null")


def scaled(rows: DataFrame, columns: list[str], passthrough: tuple[str, ...] = ()) -> DataFrame:
    """Min-max to [0, 1]; a constant column is 0.5."""
    limits = rows.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = rows.join(F.broadcast(limits))  # one row
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        value = F.when(hi > lo, F.least(F.greatest((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.5))
        out = out.withColumn(c, F.col(c) if c in passthrough else value)
    return out.select(*rows.columns)


def feature_table(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Population variance and correlation with the label (0 where a side is constant)."""
    stats = rows.agg(*(x for c in columns for x in (F.var_pop(c).alias(f"v_{c}"), F.coalesce(F.covar_pop(c, label) / F.nullif(F.stddev_pop(c) * F.stddev_pop(label), F.lit(0.0)), F.lit(0.0)).alias(f"r_{c}"))))
    return stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"v_{c}").alias("variance"), F.col(f"r_{c}").alias("correlation")) for c in columns))).alias("s")).select("s.*")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    each = rows.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    return each.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))


def minority_rows(rows: DataFrame, label: str, minority: int, columns: list[str], *order: str) -> DataFrame:
    """Synthetic row i mixes minority rows i and i + 1 (modulo their number) at (i + 1) / (needed + 1)."""
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    m, needed = sizes.get(minority, 0), max(sizes.values(), default=0) - sizes.get(minority, 0)
    own = ranked(rows.filter(F.col(label) == minority), *order).withColumn("k", F.col("place") - 1)
    ids = rows.sparkSession.range(needed if m else 0).withColumnsRenamed({"id": "i"})
    a = own.select((F.col("k")).alias("ka"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = own.select((F.col("k")).alias("kb"), *(F.col(c).alias(f"b_{c}") for c in columns))
    met = ids.withColumns({"ka": F.col("i") % max(1, m), "kb": (F.col("i") + 1) % max(1, m), "alpha": (F.col("i") + 1) / F.lit(float(needed + 1))}).join(a, "ka").join(b, "kb")
    return met.select("i", *((F.col(f"a_{c}") * (1 - F.col("alpha")) + F.col(f"b_{c}") * F.col("alpha")).alias(c) for c in columns))


def selected_features(rows: DataFrame, columns: list[str], label: str, top: int = 25, required: tuple[str, ...] = (), excluded: tuple[str, ...] = (), least_variance: float = 0.01, most_correlation: float = 0.8) -> DataFrame:
    """Features in the order of use: (place, feature, importance). Low variance and excluded ones go; in column order one that correlates
    with a kept one goes, but for required ones; the rest go by correlation with the label, optional ones before required ones.
    All variances and correlations come from one aggregation; the driver sees a number for each pair of columns."""
    corr = lambda a, b: F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    named = [c for c in columns if c not in excluded]
    stats = rows.agg(*(F.var_pop(c).alias(f"v_{c}") for c in named), *(corr(c, label).alias(f"r_{c}") for c in named)).first()
    alive = [c for c in named if (stats[f"v_{c}"] or 0.0) >= least_variance]
    must, may = [c for c in alive if c in required], [c for c in alive if c not in required]
    pairs = [(a, b) for i, a in enumerate(may) for b in may[:i]]
    near = rows.agg(*(corr(a, b).alias(f"p{k}") for k, (a, b) in enumerate(pairs))).first() if pairs else ()
    between, kept = {pair: abs(near[k] or 0.0) for k, pair in enumerate(pairs)}, []
    for c in may:
        if all(between[c, b] <= most_correlation for b in kept):
            kept.append(c)
    score = {c: abs(stats[f"r_{c}"] or 0.0) for c in [*must, *kept]}
    best = lambda names: sorted(names, key=lambda c: (-score[c], columns.index(c)))
    chosen = best(must)[:top] if len(must) >= top else best(kept)[: top - len(must)] + best(must)
    return rows.sparkSession.createDataFrame([(i, c, score[c]) for i, c in enumerate(chosen, 1)], "place long, feature string, importance double")


def category_codes(rows: DataFrame, column: str, *order: str) -> DataFrame:
    """A code for each value, by first appearance from 0; there are as many rows as values."""
    seen = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("_seen"))
    return seen.select(column, (F.row_number().over(Window.orderBy("_seen", column)) - 1).cast("long").alias("code"))
