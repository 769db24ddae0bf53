"""N-gram Jaccard join with size-banded tiles and hashed bitmap signatures (operator 9).

A document's set are its distinct word shingles (64-bit hashes). Sets that reach
the threshold share one of their prefix shingles: the first n - ceil(t * n) + 1 in
an order that all share (very common shingles last, then by hash). A count-min
sketch drops prefix shingles that occur once, and of shingles found in the same
documents one is kept.

Documents that share a prefix shingle meet in tiles by bands of set sizes: sizes
within the threshold of each other are in the same band or in neighbouring ones,
so a document is at home in its band and a visitor in the next. A tile of more
than ``tile`` documents is cut into blocks that meet two at a time. In a tile,
bitmaps bound the overlap from above (each bit one has and the other lacks is a
shingle not shared), and only pairs that pass meet as sorted arrays. Two rounds
keep the pairs few without losing a link: first every document is held against
the first of its tile; of the components this gives, only pairs of different
components are held against each other. Equal sets are one vertex throughout.

Defined cases: null, empty and blank texts have no shingles and are linked with
nothing; with fewer words than a shingle the whole sequence is the one shingle;
rows that share a doc_id are one vertex; a null doc_id gets no component;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swissline.llm.common import Poly, keyed, lower_ascii, materialize, mix, parallelism, rows_of, slices, table, text_bytes, words
from swissline.llm.components import components
from swissline.llm.firsts import inside
from swissline.llm.sketch import bits_for, repeated

_LETTERS, _WORDS = Poly(901), Poly(902)
MOST_COMMON = 1 << 20
_SETS = "doc_id long, n long, d1 long, d2 long, tokens array<bigint>, shared double, bits binary"


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int):
    """Distinct shingle hashes of each row, ascending, and how many stand before each row."""
    buf = lower_ascii(buf)
    starts, ends, bounds = words(buf, offs)
    h = mix(_LETTERS.spans(_LETTERS.prefix(buf), starts, ends))
    prefix = _WORDS.prefix(h)
    count = np.diff(bounds)
    ok = inside(len(h), bounds, k)
    grams = _WORDS.grams(prefix, k)[ok] if len(ok) else np.zeros(0, np.uint64)
    rows = rows_of(bounds)[: len(ok)][ok]
    few = np.flatnonzero((count > 0) & (count < k))
    grams = mix(np.concatenate([grams, _WORDS.spans(prefix, bounds[few], bounds[few + 1])]))
    rows = np.concatenate([rows, few])
    if len(offs) <= 4096:  # one key: row and the hash's upper bits; lower bits only differ by rare accident
        s = np.argsort(rows.astype(np.uint64) << np.uint64(52) | grams >> np.uint64(12))
        wrong = (grams[s][1:] < grams[s][:-1]) & (rows[s][1:] == rows[s][:-1])
        s = np.lexsort((grams, rows)) if wrong.any() else s
    else:
        s = np.lexsort((grams, rows))
    grams, rows = grams[s], rows[s]
    new = np.ones(len(s), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return grams[new], np.searchsorted(rows[new], np.arange(len(offs)))


def _digests(items: np.ndarray, at: np.ndarray):
    out = []
    for salt in (0x1B873593CC9E2D51, 0x7A3C9F0B5E8D2467):
        total = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(mix(items ^ np.uint64(salt)), out=total[1:])
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out


def _prefix_sizes(n: np.ndarray, t: Fraction) -> np.ndarray:
    need = -(-n * t.numerator // t.denominator)
    return np.where(n > 0, n - need + 1, 0)


def _prefixes(items, at, t, common, factor=1):
    """Which of the items are in the prefix of their row."""
    n = np.diff(at)
    row = rows_of(at)
    rank = np.arange(len(items)) - at[:-1][row]
    if len(common) and len(items):
        hot = common[np.minimum(np.searchsorted(common, items), len(common) - 1)] == items
        if hot.any():
            s = np.lexsort((items, hot, row))
            rank = np.empty(len(items), np.int64)
            rank[s] = np.arange(len(items)) - at[:-1][row[s]]
    return rank < (_prefix_sizes(n, t) * factor)[row]


def _bitmap(items: np.ndarray) -> bytes:
    width = min(1 << 17, max(64, (4 if len(items) <= 1024 else 2) << int(len(items) - 1).bit_length()))  # two to eight bits a shingle
    flags = np.zeros(width, np.uint8)
    flags[((items >> np.uint64(24)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _fold(x: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        x = (x >> width) | (x & ((1 << width) - 1))
    return x


class _Fits:
    """Whether sizes and bitmaps allow the threshold."""

    def __init__(self, t: Fraction):
        self.p, self.q = t.numerator, t.denominator

    def need(self, n: int, m: int) -> int:
        return -(-self.p * (n + m) // (self.p + self.q))

    def __call__(self, n: int, x: tuple[int, int], m: int, y: tuple[int, int]) -> bool:
        """x, y: bitmaps as (number, width)."""
        if self.q * min(n, m) < self.p * max(n, m):
            return False
        (a, wa), (b, wb) = x, y
        if wa != wb:
            a, b = _fold(a, wa, min(wa, wb)), _fold(b, wb, min(wa, wb))
        both, need = (a & b).bit_count(), self.need(n, m)
        return n - a.bit_count() + both >= need and m - b.bit_count() + both >= need


def _tiles(batches):
    """The rows of each tile, across batches, as lists of (n, v, part, home, block, bits)."""
    tile, rows = None, []
    for b in batches:
        for t, *row in zip(*(b.column(c).to_pylist() for c in ("tile", "n", "v", "part", "home", "block", "bits"))):
            if t != tile:
                if len(rows) > 1:
                    yield rows
                tile, rows = t, []
            row[-1] = int.from_bytes(row[-1], "little"), 8 * len(row[-1])
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _emit(pairs):
    """(a, b) rows; repeats inside a stretch of a task are sent once."""
    seen = set()
    for p in pairs:
        seen.add(p if p[0] < p[1] else p[::-1])
        if len(seen) >= 200_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*seen)], ["a", "b"])
            seen = set()
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*seen)], ["a", "b"])


def similar_groups(docs: DataFrame, shingle: int = 5, threshold: str = "0.8", tile: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text)."""
    spark, t = docs.sparkSession, Fraction(threshold)
    docs = keyed(docs)
    total = text_bytes(docs)
    sc = spark.sparkContext

    def fresh_sets(batches):
        """Sets of each slice, and its rows whose set is new in this task."""
        seen = set()
        for b in batches:
            ids = b.column("doc_id")
            for lo, hi, buf, offs in slices(b.column("text")):
                items, at = shingle_sets(buf, offs, shingle)
                d1, d2 = _digests(items, at)
                keep = np.zeros(hi - lo, bool)
                for i, key in enumerate(zip(d1.tolist(), d2.tolist())):
                    if at[i] < at[i + 1] and key not in seen and ids[lo + i].is_valid:
                        seen.add(key)
                        keep[i] = True
                yield ids.slice(lo, hi - lo), items, at, d1, d2, keep

    # shingles so common that they go last in the order: at most MOST_COMMON of them
    least = max(64, total // 6 // MOST_COMMON)

    def count(batches):
        parts, size = [], 0

        def flush():
            value, n = np.unique(np.concatenate(parts), return_counts=True)
            often = n >= 8
            return pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])

        for _, items, at, _, _, keep in fresh_sets(batches):
            part = items[_prefixes(items, at, t, items[:0], 2) & keep[rows_of(at)]]
            parts.append(part)
            size += len(part)
            if size > 1 << 22:
                yield flush()
                parts, size = [], 0
        if parts:
            yield flush()

    hot = docs.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    common = sc.broadcast(np.sort(np.array([r[0] for r in hot.select("token").collect()], np.int64).view(np.uint64)))

    def hashes(batches):
        for _, items, at, _, _, keep in fresh_sets(batches):
            yield items[_prefixes(items, at, t, common.value) & keep[rows_of(at)]]

    twice = sc.broadcast(repeated(docs, hashes, bits_for(int(total / 6 * 0.25))))

    def features(batches):
        for ids, items, at, d1, d2, keep in fresh_sets(batches):
            first = _prefixes(items, at, t, common.value) & keep[rows_of(at)]
            first[first] = twice.value(items[first])
            some = np.add.reduceat(np.append(first, False).astype(np.int64), at[:-1]) * (np.diff(at) > 0) if len(at) > 1 else np.zeros(0)
            tokens, bits, shared, most = [], [], [], _prefix_sizes(np.diff(at), t)
            for i in range(len(ids)):
                a, b = at[i], at[i + 1]
                if some[i]:
                    own = items[a:b]
                    tokens.append(own[first[a:b]].view(np.int64).tolist())
                    bits.append(_bitmap(own))
                    shared.append(float(some[i] / most[i]))
                else:
                    tokens.append(None), bits.append(None), shared.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(at)), pa.array(d1), pa.array(d2), pa.array(tokens, pa.list_(pa.int64())), pa.array(shared, pa.float64()), pa.array(bits, pa.binary())],
                ["doc_id", "n", "d1", "d2", "tokens", "shared", "bits"],
            )

    rows = materialize(docs.mapInArrow(features, _SETS), "sets")
    kind = ["n", "d1", "d2"]
    classes = materialize(rows.filter("n > 0 and doc_id is not null").groupBy(*kind).agg(F.min("doc_id").alias("v"), F.min(F.when(F.col("tokens").isNotNull(), F.col("doc_id"))).alias("doc_id")), "classes")
    # one row for each different set that can have a partner; repeats are dropped by the join's keys, which needs no second shuffle
    known = rows.filter("tokens is not null").join(classes, ["doc_id", *kind]).dropDuplicates(["doc_id", *kind]).select("v", *kind, "tokens", "shared", "bits")
    known = materialize(known, "vertices")
    vertices = known.drop("tokens")
    # of shingles with the same documents one is enough; those of one document are none
    each = known.select(F.explode("tokens").alias("token"), "v", "n", "shared")
    same = each.groupBy("token").agg(F.count("v").alias("c"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y"))
    one = same.filter("c > 1").groupBy("c", "x", "y").agg(F.min("token").alias("token")).select("token")
    # the bands are a little wider than the threshold, so that rounding loses no pair; what is in one band fits
    p, q = F.lit(t.numerator), F.lit(t.denominator)
    band = F.floor(F.ln("n") / F.lit(math.log(float(1 / t)) * (1 + 1e-9))) if t < 1 else F.col("n")
    banded = materialize(each.join(one, "token").withColumn("band", band.cast("long")), "banded")
    tiles = banded.groupBy("token", "band").agg(F.count("v").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.struct("shared", (-F.col("v")).alias("v"), "n")).alias("lead"))
    # some dozens of bands at most, as each stands for a quarter more shingles; written, so that the join below can split a common shingle's rows
    bands = materialize(tiles.groupBy("token").agg(F.collect_list(F.struct("band", "c", "lo", "hi", "lead")).alias("bands")), "bands")
    at = lambda step: F.get(F.filter("bands", lambda s: s.band == F.col("band") + step), 0)
    met = banded.join(bands, "token").withColumns({"own": at(0), "up": at(1), "down": at(-1)})
    # a row is at home where others of its band or smaller ones from the band below fit, and visits the band above if one there fits
    visits = F.coalesce(p * F.col("up.lo") <= q * F.col("n"), F.lit(False))
    home = (F.col("own.c") > 1) | F.coalesce(q * F.col("down.hi") >= p * F.col("n"), F.lit(False))
    first = F.when(-F.col("own.lead.v") != F.col("v"), F.col("own.lead")).otherwise(F.coalesce("up.lead", "down.lead"))  # the first of a tile meets that of the next
    sized = met.withColumns({"home": home, "visits": visits, "first": first}).filter("home or visits")
    postings = materialize(sized.select("token", "band", "v", "n", "home", "visits", (-F.col("first.v")).alias("first"), F.col("first.n").alias("m")), "postings")
    fits = _Fits(t)

    def with_first() -> DataFrame:
        """Every vertex with the one of its tile that shares the largest part of its prefix."""
        sizes = (q * F.col("n") >= p * F.col("m")) & (q * F.col("m") >= p * F.col("n"))
        pairs = postings.filter((F.col("v") != F.col("first")) & sizes).select(F.least("v", "first").alias("a"), F.greatest("v", "first").alias("b")).distinct()
        for side in ("a", "b"):
            pairs = pairs.join(vertices.select(F.col("v").alias(side), F.col("n").alias("n" + side), F.col("bits").alias("x" + side)), side)

        def run(batches):
            for rows in batches:
                x, y = ([(int.from_bytes(z, "little"), 8 * len(z)) for z in rows.column(c).to_pylist()] for c in ("xa", "xb"))
                ok = pa.array([fits(*r) for r in zip(rows.column("na").to_pylist(), x, rows.column("nb").to_pylist(), y)], pa.bool_())
                yield pa.RecordBatch.from_arrays([rows.column("a").filter(ok), rows.column("b").filter(ok)], ["a", "b"])

        return materialize(pairs.mapInArrow(run, "a long, b long"), "pairs")

    def meet(labels: DataFrame) -> DataFrame:
        """Pairs of different components that share a prefix shingle and pass the bounds."""
        own = postings.select("token", "band", "v", "home", "visits").join(labels, "v", "left").withColumn("part", F.coalesce("label", "v")).drop("label")
        stays, goes = F.when(F.col("home"), F.struct("band", F.lit(True).alias("home"))), F.when(F.col("visits"), F.struct((F.col("band") + 1).alias("band"), F.lit(False).alias("home")))
        met = own.select("token", "v", "part", F.explode(F.array_compact(F.array(stays, goes))).alias("at")).select("token", "at.band", "at.home", "v", "part")
        several = met.groupBy("token", "band").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("v").alias("c")).filter("lo <> hi")
        several = several.select("token", "band", F.ceil(F.col("c") / tile).alias("blocks"))
        met = met.join(several, ["token", "band"]).join(vertices.select("v", "n", "bits"), "v").withColumn("block", F.pmod(F.xxhash64("v"), "blocks"))
        met = met.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        key = F.xxhash64("token", "band", F.least("block", "with"), F.greatest("block", "with"))
        met = met.select(key.alias("tile"), "n", "v", "part", "home", F.when(F.col("blocks") > 1, F.struct("block", (F.col("block") == F.col("with")).alias("same"))).alias("b"), "bits")
        met = met.select("tile", "n", "v", "part", "home", F.when(~F.col("b.same"), F.col("b.block")).alias("block"), "bits")
        ordered = met.repartition(max(8, parallelism(spark)), "tile").sortWithinPartitions("tile", "n", "v")
        return materialize(ordered.mapInArrow(lambda batches: _emit(across(batches)), "a long, b long").distinct(), "pairs")

    def across(batches):
        """block is set where two blocks meet: pairs inside a block are met elsewhere."""
        for rows in _tiles(batches):
            if all(r[2] == rows[0][2] for r in rows):
                continue
            for i, (n, v, part, home, block, bits) in enumerate(rows):
                for m, w, other, at_home, its, more in rows[i + 1 :]:
                    if fits.q * n < fits.p * m:
                        break
                    if part != other and (home or at_home) and (block is None or block != its) and fits(n, bits, m, more):
                        yield v, w

    def sets_of(pairs: DataFrame) -> DataFrame:
        """v, items: the sorted sets of what is in pairs; a bitmap of their ids spares the others' texts."""
        need = materialize(pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct(), "need")

        def ids(batches):
            for b in batches:
                yield mix(b.column(0).to_numpy().view(np.uint64))

        wanted = sc.broadcast(repeated(need, ids, bits_for(need.count()), 1))

        def run(batches):
            for b in batches:
                v = pc.fill_null(b.column("doc_id"), 0).to_numpy()
                b = b.filter(pc.and_(pa.array(wanted.value(mix(v.view(np.uint64)))), pc.is_valid(b.column("doc_id"))))
                for lo, hi, buf, offs in slices(b.column("text")):
                    items, at = shingle_sets(buf, offs, shingle)
                    d1, d2 = _digests(items, at)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").slice(lo, hi - lo), pa.array(d1), pa.array(d2), pa.array([items[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())],
                        ["v", "d1", "d2", "items"],
                    )

        sets = docs.mapInArrow(run, "v long, d1 long, d2 long, items binary")
        return materialize(sets.join(vertices.join(need, "v").select("v", "d1", "d2"), ["v", "d1", "d2"]).dropDuplicates(["v", "d1", "d2"]).select("v", "items"), "items")

    def verify(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs)
        met = pairs.join(sets.select(F.col("v").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("v").alias("b"), F.col("items").alias("y")), "b")

        def run(batches):
            for b in batches:
                ok = []
                for x, y in zip(b.column("x"), b.column("y")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                    ok.append(t.denominator * both >= t.numerator * (len(x) + len(y) - both))
                ok = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

        return materialize(met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")

    links = verify(with_first())
    labels = components(links)
    more = verify(meet(labels))
    if not more.isEmpty():
        labels = components(links.union(more))

    final = classes.select(*kind, "v").join(labels, "v", "left").select(*kind, F.coalesce("label", "v").alias("_component"))
    return rows.select("doc_id", *kind).join(final, kind, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id")
    )


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
