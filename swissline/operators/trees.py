"""Bagged probability trees and boosted residual trees, grown level by level.

Values become bins first: a feature has at most sixteen thresholds, midpoints of neighbouring distinct values. A level is one pass: each
task counts the weights and targets of its rows by (tree, node, feature, bin) and sends the sums, which are added up; a tree's best splits
come from these sums. How often a row is drawn for a tree is a hash of its key, and its node follows from the tree, so rows carry no state.
The driver holds the trees: ``trees`` x 2 ** ``depth`` nodes at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from swissline.operators.durable import stored
from swissline.operators.splits import ranked

MOST_THRESHOLDS = 16
SLOTS = MOST_THRESHOLDS + 1
MOST_PACKED = 15  # features whose bins fit one number of 64 bits
CHUNK = 1 << 18  # rows that are looked at together


def thresholds(rows: DataFrame, columns: list[str]) -> DataFrame:
    """feature, place, threshold: the midpoints of neighbouring distinct values; of more than sixteen, sixteen at even places. Nulls and NaN count as nothing."""
    values = F.array(*(F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)))
    placed = ranked(rows.select(F.inline(values)).filter("value is not null and not isnan(value)").distinct(), "feature", "value")
    span = placed.groupBy("feature").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    gaps = placed.join(F.broadcast(span), "feature").withColumn("k", F.col("place") - F.col("first"))  # a row for each feature
    few = F.col("n") - 1 <= MOST_THRESHOLDS
    # which gap k (from 0, between value k and k + 1) is threshold number j
    j = F.explode(F.when(few, F.sequence(F.lit(0), (F.col("n") - 2).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(MOST_THRESHOLDS - 1))))
    wanted = span.filter("n > 1").select("feature", "n", "first", j.alias("place"))
    gap = F.when(few, F.col("place").cast("long")).otherwise(F.rint(F.col("place") * (F.col("n") - 2) / (MOST_THRESHOLDS - 1)).cast("long"))
    wanted = wanted.withColumn("gap", gap).select("feature", "place", F.inline(F.array(F.struct(F.col("gap").alias("k"), F.lit(0).alias("side")), F.struct((F.col("gap") + 1).alias("k"), F.lit(1).alias("side")))))
    met = wanted.join(gaps.select("feature", "k", "value"), ["feature", "k"])
    return met.groupBy("feature", "place").agg((F.sum("value") / 2).alias("threshold"))


def cuts_of(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """Thresholds of each column, ascending: sixteen numbers a feature at most."""
    out: list[list[float]] = [[] for _ in columns]
    for r in thresholds(rows, columns).collect():
        out[r.feature].append(r.threshold)
    return [sorted(set(x)) for x in out]


def binned(columns: list[str], cuts: list[list[float]]) -> Column:
    """The bin of each feature: how many thresholds its value is above; a null is in the lowest."""
    bins = [sum((F.coalesce(F.col(c).cast("double") > t, F.lit(False)).cast("int") for t in ts), F.lit(0)) for c, ts in zip(columns, cuts)]
    return F.array(*bins)


# ---------------------------------------------------------------- draws
def uniform(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) for each key, by a public-domain scrambling of 64 bits."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) & (1 << 64) - 1)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def bagged(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with mean one, as drawing all rows with replacement gives."""
    return np.searchsorted(_POISSON, uniform(keys, seed, tree), "right")


def sampled(share: float):
    return lambda keys, seed, tree: (uniform(keys, seed, tree) < share).astype(np.int64)


# ---------------------------------------------------------------- trees
@dataclass
class Trees:
    """Trees over bins as arrays (trees, nodes): node k has the children 2k + 1 and 2k + 2; feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    columns: list[str] = field(default_factory=list)
    cuts: list[list[float]] = field(default_factory=list)
    base: float = 0.0
    rate: float = 0.0

    @classmethod
    def empty(cls, trees: int, depth: int) -> Trees:
        n = (1 << depth + 1) - 1
        return cls(np.full((trees, n), -1, np.int32), np.zeros((trees, n), np.int32), np.zeros((trees, n)))

    def node(self, tree: int, bins: np.ndarray, steps: int) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(steps):
            f = self.feature[tree, at]
            right = bins[rows, np.maximum(f, 0)] > self.bin[tree, at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at

    def depth(self) -> int:
        return (self.feature.shape[1] + 1).bit_length() - 2

    def mean(self, bins: np.ndarray) -> np.ndarray:
        n = len(self.feature)
        return sum((self.value[t, self.node(t, bins, self.depth())] for t in range(n)), np.zeros(len(bins))) / max(n, 1)

    def score(self, bins: np.ndarray, first: int) -> np.ndarray:
        """Base and what the first trees add, in log odds."""
        out = np.full(len(bins), self.base)
        for t in range(first):
            out += self.rate * self.value[t, self.node(t, bins, self.depth())]
        return out


def _matrix(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(-1, k).astype(np.int64)


def _joined(batches, model: Trees, k: int, target):
    """Bins, keys, weights and targets of some batches at a time."""
    waiting, rows = [], 0

    def joined():
        return tuple(np.concatenate(x) for x in zip(*((_matrix(b, k), b.column("key").to_numpy(), b.column("weight").to_numpy(), target(model, b, k)) for b in waiting)))

    for b in batches:
        waiting.append(b)
        rows += b.num_rows
        if rows >= CHUNK:
            yield joined()
            waiting, rows = [], 0
    if rows:
        yield joined()


_SUMS = "tree int, node int, feature int, bin int, n double, w double, y double"


def _level(rows: DataFrame, k: int, model: Trees, trees: range, level: int, draw, seed: int, target) -> list:
    """Sums of rows, weights and weighted targets of each bin, of the nodes at ``level``."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        low, width = (1 << level) - 1, 1 << level
        for bins, key, weight, y in _joined(batches, held.value, k, target):
            # rows of the same bins take the same way through every tree: it is found once for all of them
            kinds, at_kind = np.unique(bins @ SLOTS ** np.arange(k), return_inverse=True) if k <= MOST_PACKED else (np.arange(len(bins)), np.arange(len(bins)))
            first = np.zeros(len(kinds), np.int64)
            first[at_kind] = np.arange(len(bins))
            bins = bins[first]
            for t in trees:
                times = draw(key, seed, t)
                w = times * weight
                own = [np.bincount(at_kind, x, len(kinds)) for x in (times, w, w * y)]
                at = held.value.node(t, bins, level) - low
                use = np.flatnonzero((own[0] > 0) & (at >= 0))
                own = [x[use] for x in own]
                for f in range(k):
                    cell = at[use] * SLOTS + bins[use, f]
                    size = width * SLOTS
                    added = np.stack([np.bincount(cell, x, size) for x in own])
                    sums[t, f] = sums[t, f] + added if (t, f) in sums else added
        for (t, f), own in sums.items():
            cell = np.flatnonzero(own[0])
            n = len(cell)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array((cell // SLOTS + low).astype(np.int32)), pa.array(np.full(n, f, np.int32)), pa.array((cell % SLOTS).astype(np.int32)), *(pa.array(x[cell]) for x in own)], [x.split()[0] for x in _SUMS.split(", ")])

    added = rows.select("bins", "key", "weight", "label").mapInArrow(run, _SUMS).groupBy("tree", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("y").alias("y"))
    return added


def best_split(n: np.ndarray, w: np.ndarray, y: np.ndarray, least: int) -> tuple[float, int, int]:
    """Gain, feature and bin of a node's best split from (features, bins) sums; the first of equals. The gain is the weighted fall of the
    squared error of the targets, which for labels of 0 and 1 is half the fall of the Gini impurity."""
    def part(a):
        left = np.cumsum(a, 1)[:, :-1]
        return left, a.sum(1, keepdims=True) - left

    (nl, nr), (wl, wr), (yl, yr) = part(n), part(w), part(y)
    total = y.sum(1, keepdims=True) ** 2 / np.maximum(w.sum(1, keepdims=True), 1e-300)
    gain = np.where((nl >= least) & (nr >= least) & (wl > 0) & (wr > 0), yl**2 / np.maximum(wl, 1e-300) + yr**2 / np.maximum(wr, 1e-300) - total, -np.inf)
    f, b = divmod(int(np.argmax(np.round(gain, 9))), gain.shape[1])
    return float(gain[f, b]), f, b


def _grow(rows: DataFrame, k: int, model: Trees, trees: range, depth: int, draw, seed: int, target, least: int, need: int) -> None:
    """Levels of the trees, into ``model``. least: rows on either side; need: rows that a node has to have to be split."""

    def choose(t: pa.Table) -> pa.Table:
        node, f, b = (t.column(c).to_numpy() for c in ("node", "feature", "bin"))
        out = []
        for x in np.unique(node):
            s = np.zeros((3, k, SLOTS))
            m = node == x
            for i, c in enumerate(("n", "w", "y")):
                s[i, f[m], b[m]] = t.column(c).to_numpy()[m]
            n, w, y = s[:, 0].sum(1)
            gain, feature, at = best_split(*s, least) if n >= need else (-np.inf, -1, 0)
            out.append((t.column("tree")[0].as_py(), int(x), feature if gain > 1e-9 else -1, at, y / w if w > 0 else 0.0))
        return pa.table({c: pa.array(v, kind) for c, v, kind in zip(("tree", "node", "feature", "bin", "value"), zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))})

    for level in range(depth + 1):
        sums = _level(rows, k, model, trees, level, draw, seed, target)
        found = sums.groupBy("tree").applyInArrow(choose, "tree int, node int, feature int, bin int, value double").collect()  # nodes
        for r in found:
            model.value[r.tree, r.node] = r.value
            if level < depth:
                model.feature[r.tree, r.node], model.bin[r.tree, r.node] = r.feature, r.bin
        if not any(r.feature >= 0 for r in found):
            break


def _prepared(rows: DataFrame, columns: list[str], cuts: list[list[float]], key: str, label: str, weight: Column | None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return stored(rows.filter(F.col(label).isNotNull()).select(binned(columns, cuts).alias("bins"), F.xxhash64(key).alias("key"), w.alias("weight"), F.col(label).cast("double").alias("label")), "binned")


def fit_forest(rows: DataFrame, columns: list[str], key: str, label: str = "label", trees: int = 150, depth: int = 8, least: int = 3, seed: int = 13, weight: Column | None = None) -> Trees:
    """Bagged trees that split by Gini impurity; a leaf's value is its share of label 1. ``key`` tells rows apart for the draws."""
    cuts = cuts_of(rows, columns)
    model = Trees.empty(trees, depth)
    model.columns, model.cuts = columns, cuts
    _grow(_prepared(rows, columns, cuts, key, label, weight), len(columns), model, range(trees), depth, bagged, seed, lambda m, b, k: b.column("label").to_numpy(), least, 2 * least)
    return model


def fit_boosting(rows: DataFrame, columns: list[str], key: str, label: str = "label", rounds: int = 120, rate: float = 0.08, depth: int = 6, share: float = 0.8, seed: int = 13, weight: Column | None = None) -> Trees:
    """Trees of what the ones before them leave, in log odds from the share of label 1 on; each sees ``share`` of the rows. A level is a job."""
    cuts = cuts_of(rows, columns)
    held = _prepared(rows, columns, cuts, key, label, weight)
    p = held.agg(F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).first()[0]
    model = Trees.empty(rounds, depth)
    p = min(max(0.5 if p is None else p, 1e-6), 1 - 1e-6)
    model.columns, model.cuts, model.base, model.rate = columns, cuts, math.log(p / (1 - p)), rate
    for r in range(rounds):
        left = lambda m, b, k, r=r: b.column("label").to_numpy() - 1 / (1 + np.exp(-m.score(_matrix(b, k), r)))
        _grow(held, len(columns), model, range(r, r + 1), depth, sampled(share), seed, left, 1, 2)
    return model


def with_probability(rows: DataFrame, model: Trees, out: str = "p") -> DataFrame:
    """``rows`` with the probability of label 1."""
    rows = rows.drop(out)
    names, k = rows.columns, len(model.columns)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            bins = _matrix(b, k)
            p = 1 / (1 + np.exp(-m.score(bins, len(m.feature)))) if m.rate else np.clip(m.mean(bins), 1e-6, 1 - 1e-6)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(p)], [*names, out])

    schema = StructType([*rows.schema.fields, StructField(out, DoubleType())])
    return rows.withColumn("bins", binned(model.columns, model.cuts)).mapInArrow(run, schema)
