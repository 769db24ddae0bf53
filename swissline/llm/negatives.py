"""Hard-negative mining with bit-sliced integer products (operator 13).

Vectors are small integers. A product of an anchor with a row is summed over the
row's bit planes, the most significant first; what the planes still to come can
add lies between their weight times the sum of the anchor's negative and of its
positive components, so each score is known as an interval that halves with
every plane. A pair is dropped once its interval can't reach the best known, or
can't meet the range that is asked for. While many pairs are left a plane is one
matrix product for all of them; the few that stay are taken through the lower
planes by counting the bits that the packed planes of both sides share.

Anchors and rows meet in tiles of bounded size: every row is compared with every
anchor by blocks, none is held whole. Each tile returns its best for each
anchor, and the best of those are taken by a window with a limit.

Defined cases: equal scores go by smaller vec_id, null ids last; repeated rows
are rows of their own, as anchors too, and an anchor leaves out one copy of
itself; a shorter vector is filled with zeros, an empty one scores 0; null
labels, null vectors and null or non-finite components take no part; components
within 2**26 are exact, beyond that scores may leave 64 bits; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swissline.llm.common import parallelism, table

ANCHORS, ROWS = 256, 8192  # of a block of pairs that are held at once
SPARSE = 1 / 16
_FAR = np.int64(1) << 62


# ---------------------------------------------------------------- bit planes
class Planes:
    """The bits of integer rows, two's complement: weights and matrices of 0 and 1, the most significant first."""

    def __init__(self, x: np.ndarray, bits: int):
        self.x, self.bits, self._packed = x, bits, None

    def weight(self, k: int) -> int:
        return -(1 << k) if k == self.bits - 1 else 1 << k

    def dense(self, k: int, rows: slice, kind) -> np.ndarray:
        return ((self.x[rows] >> k) & 1).astype(kind)

    def packed(self, k: int) -> np.ndarray:
        """Rows of 64-bit words."""
        if self._packed is None:
            n, d = self.x.shape
            words = -(-max(d, 1) // 64)
            self._packed = np.zeros((self.bits, n, words), np.uint64)
            for p in range(self.bits):
                bits = np.zeros((n, words * 64), np.uint8)
                bits[:, :d] = (self.x >> p) & 1
                self._packed[p] = np.packbits(bits, axis=1).view(np.uint64)
        return self._packed[k]


def sliced(anchors: Planes, ai: np.ndarray, rows: Planes, ri: np.ndarray, k: int) -> np.ndarray:
    """Products of anchors ``ai`` with plane k of rows ``ri``, without its weight."""
    out, bits = np.zeros(len(ai), np.int64), rows.packed(k)[ri]
    for p in range(anchors.bits):
        out += anchors.weight(p) * np.bitwise_count(anchors.packed(p)[ai] & bits).sum(1, dtype=np.int64)
    return out


def ranked_in(ai: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by anchor, then keys, and the place of each of that order within its anchor."""
    order = np.lexsort((*reversed(keys), ai))
    a = ai[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    return order, np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))


def kth(ai: np.ndarray, value: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th largest value of each of n anchors; the least of all where there are fewer."""
    out = np.full(n, -_FAR)
    order, place = ranked_in(ai, -value)
    at = order[place == k - 1]
    out[ai[at]] = value[at]
    return out


class Search:
    """Pairs of a tile through the planes. Subclasses say what can still qualify."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray, bits: int):
        self.a, self.r, self.bits = Planes(anchors, bits), Planes(rows, bits), bits
        self.low, self.high = np.minimum(anchors, 0).sum(1), np.maximum(anchors, 0).sum(1)
        # all sums are whole numbers below these, so matrix products of floats are exact
        self.kind = np.float32 if bits < 12 and rows.shape[1] << (2 * bits - 2) < 1 << 24 else np.float64

    def run(self):
        """(anchor, row, score) of the pairs that qualify, and maybe some that don't."""
        found = [self.block(slice(i, i + ANCHORS), slice(j, j + ROWS)) for j in range(0, len(self.r.x), ROWS) for i in range(0, len(self.a.x), ANCHORS)]
        return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*found)] or [np.zeros(0, np.int64)] * 3

    def block(self, aa: slice, rr: slice):
        a, low, high = self.a.x[aa].astype(self.kind), self.low[aa, None], self.high[aa, None]
        sums = np.zeros((len(a), len(self.r.x[rr])), self.kind)
        k, left = self.bits - 1, self.fresh(aa, rr)
        while True:
            sums += self.kind(self.r.weight(k)) * (a @ self.r.dense(k, rr, self.kind).T)
            rest = (1 << k) - 1
            left &= self.dense_left(aa, sums + (rest * low).astype(self.kind), sums + (rest * high).astype(self.kind), left)
            if not k or np.count_nonzero(left) < SPARSE * left.size:
                break
            k -= 1
        ai, ri = np.nonzero(left)
        p = sums[ai, ri].astype(np.int64)
        ai, ri = ai + aa.start, ri + rr.start
        for k in range(k - 1, -1, -1):
            p = p + self.r.weight(k) * sliced(self.a, ai, self.r, ri, k)
            rest = (1 << k) - 1
            keep = self.sparse_left(ai, p + rest * self.low[ai], p + rest * self.high[ai])
            ai, ri, p = ai[keep], ri[keep], p[keep]
        self.seen(ai, p)
        return ai, ri, p


class Best(Search):
    """The first ``k`` rows of each anchor."""

    def __init__(self, anchors, rows, bits, k):
        super().__init__(anchors, rows, bits)
        self.k, self.least = k, np.full(len(anchors), -_FAR)

    def fresh(self, aa, rr):
        return np.ones((len(self.a.x[aa]), len(self.r.x[rr])), bool)

    def dense_left(self, aa, low, high, left):
        if low.shape[1] >= self.k:
            self.least[aa] = np.maximum(self.least[aa], np.partition(np.where(left, low, -np.inf), -self.k, axis=1)[:, -self.k].clip(-float(_FAR)).astype(np.int64))
        return high >= self.least[aa, None]

    def sparse_left(self, ai, low, high):
        self.least = np.maximum(self.least, kth(ai, low, self.k, len(self.least)))
        return high >= self.least[ai]

    def seen(self, ai, score):
        self.least = np.maximum(self.least, kth(ai, score, self.k, len(self.least)))


class Between(Search):
    """The first ``k`` rows of another label in each of an anchor's ranges (lo to hi, anchors x ranges)."""

    def __init__(self, anchors, rows, bits, k, anchor_label, row_label, lo, hi):
        super().__init__(anchors, rows, bits)
        self.k, self.al, self.rl, self.lo, self.hi = k, anchor_label, row_label, lo, hi
        some = lo <= hi
        self.bottom, self.top = np.where(some, lo, _FAR).min(1, initial=_FAR), np.where(some, hi, -_FAR).max(1, initial=-_FAR)
        self.least = lo.copy()

    def fresh(self, aa, rr):
        return (self.al[aa, None] != self.rl[None, rr]) & (self.bottom[aa, None] <= self.top[aa, None])

    def dense_left(self, aa, low, high, left):
        return (high >= self.bottom[aa, None]) & (low <= self.top[aa, None])

    def sparse_left(self, ai, low, high):
        keep = np.zeros(len(ai), bool)
        for j in range(self.lo.shape[1]):
            lo, hi = self.lo[ai, j], self.hi[ai, j]
            sure = (low >= lo) & (high <= hi)
            self.least[:, j] = np.maximum(self.least[:, j], kth(ai[sure], low[sure], self.k, len(self.least)))
            keep |= (low <= hi) & (high >= self.least[ai, j])
        return keep

    def seen(self, ai, score):
        self.sparse_left(ai, score, score)


# ---------------------------------------------------------------- tiles
def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of d whole numbers, shorter ones filled with zeros."""
    arr = column.combine_chunks()
    n = np.diff(arr.offsets.to_numpy())
    out = np.zeros((len(n), d), np.int64)
    out[np.arange(d) < n[:, None]] = arr.flatten().to_numpy(zero_copy_only=False)
    return out


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().astype(np.int64)


_BEST = "a_rid long, a_id long, rid long, vec_id long, score long"
_FOUND = "a_rid long, a_id long, copies long, j int, positive_id long, positive_score long, rid long, negative_id long, negative_score long"


def _best_of(bits: int, d: int, k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            x, a, xl, al = _matrix(rows.column("q"), d), _matrix(anchors.column("q"), d), _numbers(rows, "label"), _numbers(anchors, "label")
            known, rid = _null_last(rows), _numbers(rows, "rid")
            for label in np.unique(al):
                ra, rx = np.flatnonzero(al == label), np.flatnonzero(xl == label)
                ai, ri, score = Best(a[ra], x[rx], bits, k).run()
                ai, ri = ra[ai], rx[ri]
                order, place = ranked_in(ai, -score, known[ri], rid[ri])
                at = order[place < k]
                out.append((ai[at], ri[at], score[at]))
        ai, ri, score = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"a_rid": anchors.column("rid").take(ai), "a_id": anchors.column("vec_id").take(ai), "rid": rows.column("rid").take(ri), "vec_id": rows.column("vec_id").take(ri), "score": pa.array(score, pa.int64())})

    return run


def _null_last(rows: pa.Table) -> np.ndarray:
    return rows.column("vec_id").fill_null(2**63 - 1).to_numpy().astype(np.int64)


def _found_of(bits: int, d: int, k: int, most: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            x, a = _matrix(rows.column("q"), d), _matrix(anchors.column("q"), d)
            lists = anchors.column("positives").to_pylist()
            lo, hi = np.ones((len(a), most), np.int64), np.zeros((len(a), most), np.int64)
            for i, ps in enumerate(lists):
                for j, p in enumerate(ps):
                    lo[i, j], hi[i, j] = -(-low * p["score"] // 100), high * p["score"] // 100
            ai, ri, score = Between(a, x, bits, k, _numbers(anchors, "label"), _numbers(rows, "label"), lo, hi).run()
            known, rid = _null_last(rows), _numbers(rows, "rid")
            for j in range(most):
                at = np.flatnonzero((score >= lo[ai, j]) & (score <= hi[ai, j]))
                order, place = ranked_in(ai[at], -score[at], known[ri[at]], rid[ri[at]])
                at = at[order[place < k]]
                out.append((ai[at], ri[at], score[at], np.full(len(at), j)))
        ai, ri, score, js = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
        ps = [lists[i][j] for i, j in zip(ai.tolist(), js.tolist())]
        return pa.table({
            "a_rid": anchors.column("rid").take(ai), "a_id": anchors.column("vec_id").take(ai), "copies": anchors.column("copies").take(ai), "j": pa.array(js, pa.int32()),
            "positive_id": pa.array([p["vec_id"] for p in ps], pa.int64()), "positive_score": pa.array([p["score"] for p in ps], pa.int64()),
            "rid": rows.column("rid").take(ri), "negative_id": rows.column("vec_id").take(ri), "negative_score": pa.array(score, pa.int64()),
        })

    return run


def mine_negatives(vectors: DataFrame, anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, rows_a_tile: int = 1 << 16, anchors_a_tile: int = 1 << 12) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of another label whose score
    is between ``low`` and ``high`` percent of the positive's.

    vectors: vec_id, label, q (array of whole numbers); anchor: a condition on its columns.
    """
    spark = vectors.sparkSession
    given = vectors.filter("label is not null and q is not null and forall(q, x -> x is not null)")
    rows = given.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("q").cast("array<long>").alias("q"))
    rows = rows.withColumn("rid", F.xxhash64("vec_id", "label", "q"))
    size = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(anchor, F.lit(False))).alias("anchors"), F.max(F.greatest(F.array_max("q"), -F.array_min("q") - 1)).alias("most"), F.max(F.size("q")).alias("d")).first()
    bits, d = int(size.most or 0).bit_length() + 1, int(size.d or 0)
    down, across = max(1, -(-size.anchors // anchors_a_tile)), max(4 * parallelism(spark), -(-size.n // rows_a_tile))

    own = rows.filter(anchor).groupBy("vec_id", "label", "q", "rid").agg(F.count("*").alias("copies"))
    small = "array<short>" if bits <= 16 else "array<int>" if bits <= 32 else "array<long>"
    tiled = rows.select("vec_id", "label", "rid", F.col("q").cast(small).alias("q"), F.pmod("rid", F.lit(across)).cast("long").alias("_j"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_i"))

    def meet(anchors: DataFrame, run, schema: str) -> DataFrame:
        anchors = anchors.withColumns({"q": F.col("q").cast(small), "_i": F.pmod("rid", F.lit(down)).cast("int"), "_j": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long")))})
        anchors = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))  # columns of their own: both sides stem from one table
        return tiled.groupBy("_i", "_j").cogroup(anchors.groupBy("_i", "_j")).applyInArrow(run, schema)

    best = meet(own, _best_of(bits, d, positives + 1), _BEST)
    by = Window.partitionBy("a_rid", "a_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "rid")
    best = best.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= positives + 1)
    lists = best.groupBy("a_rid", "a_id").agg(F.sort_array(F.collect_list(F.struct("place", "rid", "vec_id", "score"))).alias("l"))
    at = F.array_position(F.col("l.rid"), F.col("a_rid"))  # itself, once
    others = F.filter("l", lambda p, i: i != at - 1)
    chosen = lists.select(F.col("a_rid").alias("rid"), F.col("a_id").alias("vec_id"), F.transform(F.slice(others, 1, positives), lambda p: F.struct(p.vec_id.alias("vec_id"), p.score.alias("score"))).alias("positives"))
    found = meet(own.join(chosen, ["rid", "vec_id"]), _found_of(bits, d, negatives, positives, low, high), _FOUND)
    by = Window.partitionBy("a_rid", "a_id", "j").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last(), "rid")
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= negatives)
    each = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    return each.select(F.col("a_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def whole_numbers(embeddings: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label, q: components times ``scale``, rounded down; rows without a label or with a component that isn't a finite number go."""
    sound = f"label is not null and {vector} is not null and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return embeddings.filter(sound).select("vec_id", "label", F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("q"))


def op13_bit_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)
