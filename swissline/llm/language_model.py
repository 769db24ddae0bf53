"""Scoring documents with a gated recurrent language model (operator 4).

Word counts over all training rows are exact: those of the ``FREQUENT`` most
common words as sums of task vectors, all others in buckets by word hash, which
also return to each document its part of the scores. The shortlist holds the
most common words, a 256th of the distinct training words, 4,096 to 32,768 of
them, in classes by frequency; the rest is in tail groups by last letters, where
a word's share is (c + 0.5) / (N + 0.5 (V + 1)) with the group's N and V.

Training rows are dealt by hash of id and text to trainers of about
``trainer_tokens`` tokens and to ``rounds``. In a round every trainer starts
from the mean model of the round before and learns its rows of this round in
the order of their hashes, a gradient from every token; the models are averaged
by tokens. So neither the model nor a score depends on how the input is
partitioned. Scoring carries the state over each whole document.

Defined cases: null and empty texts are one end token; without training rows all
words are unknown and the model is untrained; very long texts are scored in one
lane each, and learned in pieces of 1,024 tokens; repeated rows (same id, same
text) are scored alike and counted each; a null doc_id counts as the text "" for
held_out; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swissline.llm.common import NULL_ID, Poly, batch, by_key, fan_out, ids_of, keyed, lower_ascii, materialize, mix, pack, rows_of, slices, table, text_bytes, unpack, unpack_all, words
from swissline.llm.recurrent import Model, Trainer, class_bounds, log_probability

_LETTERS = Poly(401)
END = np.uint64(0x5EED0E4D5EED0E4D)
TAILS = 32
FREQUENT = (1 << 16) - TAILS  # with the tail groups, codes of 16 bits
CHUNK_TOKENS = 2_000_000
_CODED = pa.schema([("part", pa.int32()), ("bucket", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary()), *((n, pa.int64()) for n in ("id", "rid", "key")), ("held_out", pa.bool_())])
_CODED_OF = "part int, bucket long, kind int, blob binary, id long, rid long, key long, held_out boolean"
COUNTS, HELD_OUT = -2, -1  # parts of the table of codes that belong to no round
_MOVES = pa.schema([("piece", pa.int32()), ("grp", pa.int32()), ("weight", pa.int64()), ("blob", pa.binary()), ("unit", pa.float64())])
_MOVES_OF = "piece int, grp int, weight long, blob binary, unit double"
MERGED = 256  # models in a step of averaging
_RARE = (np.uint64, np.int64, np.int64, np.uint32, np.uint8, np.uint8)


def is_held_out(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def tokens_of(buf: np.ndarray, offs: np.ndarray):
    """Word hashes with an end after each row, their tail groups, and tokens before each row."""
    buf = lower_ascii(buf)
    starts, ends, bounds = words(buf, offs)
    h = mix(_LETTERS.spans(_LETTERS.prefix(buf), starts, ends))
    last = buf[ends - 1].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    second = np.where(ends - starts > 1, buf[np.maximum(ends - 2, 0)], 0).astype(np.int64) if len(ends) else last
    rows = len(offs) - 1
    at = np.arange(len(h)) + rows_of(bounds)
    out, group = np.full(len(h) + rows, END), np.zeros(len(h) + rows, np.uint8)
    out[at], group[at] = h, ((last * 31 + second * 7) % TAILS).astype(np.uint8)
    return out, group, bounds + np.arange(rows + 1)


def token_chunks(batches, most: int = CHUNK_TOKENS):
    """(ids, rids, held out, hashes, groups, bounds) of some rows at a time."""

    def joined():
        sizes = np.concatenate([np.diff(p[5]) for p in parts])
        return *(np.concatenate([p[i] for p in parts]) for i in range(5)), np.concatenate([[0], np.cumsum(sizes)])

    parts, n = [], 0
    for b in batches:
        ids, rids = ids_of(b)
        held = b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, buf, offs in slices(b.column("text")):
            h, g, bounds = tokens_of(buf, offs)
            parts.append((ids[lo:hi], rids[lo:hi], held[lo:hi], h, g, bounds))
            n += len(h)
            if n >= most:
                yield joined()
                parts, n = [], 0
    if parts:
        yield joined()


class Vocabulary:
    """Sorted frequent hashes with what is known of each."""

    def __init__(self, frequent: np.ndarray):
        self.words = frequent

    def find(self, h: np.ndarray):
        """Place of each hash among the frequent words, and whether it is there."""
        if not len(self.words):
            return np.zeros(len(h), np.int32), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1).astype(np.int32)
        return at, self.words[at] == h


class Codes:
    """What the model has to know of each 16-bit code: one for each frequent word, then one for each tail group."""

    def __init__(self, counts, tail_of, rank, at, n_tail, v_tail):
        short, groups = int(at[-1]), np.append(tail_of, np.arange(TAILS))
        rank = np.append(rank, np.full(TAILS, short))
        listed = rank < short
        own = np.searchsorted(at, np.minimum(rank, short - 1), "right") - 1
        self.klass = np.where(listed, own, groups + len(at) - 1).astype(np.int16)
        self.within = np.where(listed, rank - at[own], 0).astype(np.int32)
        self.input = np.where(listed, rank, groups + short).astype(np.int32)
        self.first = np.int32(short + TAILS)
        self.logs = np.append(np.log10(counts + 0.5), np.zeros(TAILS))
        self.share = np.where(listed, 0.0, self.logs - np.log10(n_tail + 0.5 * (v_tail + 1))[groups])
        self.met = np.append(counts > 0, np.zeros(TAILS, bool)).astype(np.int64)

    def before(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number of the token before each, a number of its own where a document begins."""
        out = np.empty(len(codes), np.int32)
        out[1:] = self.input[codes[:-1]]
        out[bounds[:-1]] = self.first
        return out


def coded_chunks(batches, columns: tuple[str, ...], split: str | None = None, most: int = CHUNK_TOKENS):
    """(values of ``columns``, codes, bounds) of some rows at a time, rows of different ``split`` apart."""

    def joined():
        return [list(x) for x in zip(*rows)], np.frombuffer(b"".join(blobs), np.uint16), np.concatenate([[0], np.cumsum([len(x) // 2 for x in blobs])])

    now, rows, blobs, size = None, [], [], 0
    for b in batches:
        of = b.column(split).to_pylist() if split else [None] * b.num_rows
        for s, blob, *row in zip(of, b.column("blob").to_pylist(), *(b.column(c).to_pylist() for c in columns)):
            if blobs and (s != now or size >= 2 * most):
                yield joined()
                rows, blobs, size = [], [], 0
            now = s
            rows.append(row)
            blobs.append(blob)
            size += len(blob)
    if blobs:
        yield joined()


def score_documents(
    docs: DataFrame, hidden: int = 24, rounds: int = 4, trainer_tokens: int = 4_000_000, least_short: int = 1 << 12, most_short: int = 1 << 15, frequent: int = FREQUENT
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text)."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    # a null id stands as the largest; the sign of rid tells them apart
    rid = F.when(F.col("doc_id").isNull(), F.col("rid").bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("rid").bitwiseAND(F.lit(int(NULL_ID))))
    docs = keyed(docs).withColumn("held_out", is_held_out()).withColumn("rid", rid)
    total = text_bytes(docs)
    buckets, groups = fan_out(spark, total, 2 << 20), fan_out(spark, total, 1 << 20)

    # 1. the words counted exactly by vectors: any fixed list will do, the most common ones save the most
    def common(batches):
        for _, _, _, h, _, _ in token_chunks(batches):
            value, n = np.unique(h, return_counts=True)
            top = np.argsort(-n, kind="stable")[:frequent]
            yield pa.RecordBatch.from_arrays([pa.array(value[top].view(np.int64)), pa.array(n[top].astype(np.int64))], ["word", "n"])

    listed = docs.filter(~F.col("held_out")).mapInArrow(common, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(frequent)
    vocabulary = Vocabulary(np.sort(np.array([r[0] for r in listed.select("word").collect()], np.int64).view(np.uint64)))
    known = sc.broadcast(vocabulary)

    # 2. exact counts: vectors of the frequent words by shard, all other words to buckets; and the codes of each row, by round
    shards = 64
    step = -(-max(1, len(vocabulary.words)) // shards)

    def counted_row(bucket, kind, blob):
        return batch(_CODED, [COUNTS], [bucket], [kind], [blob], [None], [None], [None], [None])

    def count(batches):
        vector, tail = np.zeros(step * shards, np.int64), np.zeros(step * shards, np.int64)
        for ids, rids, held, h, g, bounds in token_chunks(batches):
            row = rows_of(bounds)
            at, there = known.value.find(h)
            learn = ~held[row]
            codes = np.where(there, at, g + np.int32(len(known.value.words))).astype(np.uint16).tobytes()
            key = mix(mix(ids.view(np.uint64)) ^ rids.view(np.uint64))
            parts = np.where(held, HELD_OUT, (key >> np.uint64(40)) % np.uint64(rounds)).astype(np.int32)
            for lo in range(0, len(ids), 2000):
                own = slice(lo, lo + 2000)
                blobs = [codes[2 * a : 2 * b] for a, b in zip(bounds[:-1][own].tolist(), bounds[1:][own].tolist())]
                yield batch(_CODED, parts[own], [None] * len(blobs), [None] * len(blobs), blobs, ids[own], rids[own], key.view(np.int64)[own], held[own])
            vector += np.bincount(at[there & learn], minlength=len(vector))
            tail[at[there]] = g[there]
            rare = np.flatnonzero(~there)
            if len(rare):
                s = rare[np.lexsort((h[rare], row[rare]))]
                new = np.ones(len(s), bool)
                new[1:] = (h[s][1:] != h[s][:-1]) | (row[s][1:] != row[s][:-1])
                first = np.flatnonzero(new)
                n, s = np.diff(np.append(first, len(s))), s[first]
                for bucket, p in by_key((h[s] >> np.uint64(16)) % np.uint64(buckets)):
                    q = s[p]
                    yield counted_row(int(bucket), 0, pack(h[q], ids[row[q]], rids[row[q]], n[p].astype(np.uint32), g[q].astype(np.uint8), learn[q].astype(np.uint8)))
        for i in range(shards):
            part = slice(i * step, (i + 1) * step)
            if vector[part].any() or tail[part].any():
                yield counted_row(-1 - i, 1, pack(vector[part], tail[part]))

    def gather(t: pa.Table) -> pa.Table:
        blobs = [x.as_buffer() for x in t.column("blob")]
        bucket = t.column("bucket")[0].as_py()
        if bucket < 0:
            vector, tail = np.zeros(step, np.int64), np.zeros(step, np.int64)
            for b in blobs:
                v, g = unpack(b, np.int64, np.int64)
                vector += v
                tail = np.maximum(tail, g)
            return pa.table({"grp": [bucket], "blob": pa.array([pack(vector, tail)], pa.binary())})
        h, ids, rids, n, g, learn = unpack_all(blobs, *_RARE)
        value, at = np.unique(h, return_inverse=True)
        c = np.bincount(at, n.astype(float) * learn, len(value))
        group = np.zeros(len(value), np.int64)
        group[at] = g
        n_of = np.bincount(group, c, TAILS).astype(np.int64)
        v_of = np.bincount(group[c > 0], minlength=TAILS).astype(np.int64)
        s = np.lexsort((rids, ids))
        new = np.ones(len(s), bool)
        new[1:] = (ids[s][1:] != ids[s][:-1]) | (rids[s][1:] != rids[s][:-1])
        row = np.empty(len(s), np.int64)
        row[s] = np.cumsum(new) - 1
        rows = int(new.sum())
        logs = np.bincount(row, n * np.log10(c[at] + 0.5), rows)
        seen = np.bincount(row, n * (c[at] > 0), rows).astype(np.int64)
        ids, rids = ids[s[new]], rids[s[new]]
        grp, out = [-1_000_000 - bucket], [pack(n_of, v_of)]
        for x, p in by_key(rids % groups):
            grp.append(int(x))
            out.append(pack(ids[p], rids[p], logs[p], seen[p]))
        return pa.table({"grp": pa.array(grp, pa.int64()), "blob": pa.array(out, pa.binary())})

    coded = materialize(docs.mapInArrow(count, _CODED_OF), "codes", "part")
    counted = materialize(coded.filter(F.col("part") == COUNTS).select("bucket", "kind", "blob").groupBy("bucket").applyInArrow(gather, "grp long, blob binary"), "counts")
    counts, tail_of = np.zeros(step * shards, np.int64), np.zeros(step * shards, np.int64)
    for grp, blob in counted.filter((F.col("grp") < 0) & (F.col("grp") >= -shards)).collect():  # one row for each shard
        at = (-1 - grp) * step
        counts[at : at + step], tail_of[at : at + step] = unpack(blob, np.int64, np.int64)

    def add(batches):
        n, v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
        for b in batches:
            for x in b.column(0):
                a, c = unpack(x.as_buffer(), np.int64, np.int64)
                n, v = n + a, v + c
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAILS)), pa.array(n), pa.array(v)], ["g", "n", "v"])

    n_tail, v_tail = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for g, n, v in counted.filter("grp <= -1000000").select("blob").mapInArrow(add, "g long, n long, v long").groupBy("g").agg(F.sum("n"), F.sum("v")).collect():
        n_tail[g], v_tail[g] = n, v
    counts, tail_of = counts[: len(vocabulary.words)], tail_of[: len(vocabulary.words)]
    n_all, v_all = int(counts.sum() + n_tail.sum()), int((counts > 0).sum() + v_tail.sum())

    # 3. the shortlist, its classes, and the tail groups
    short = max(1, min(len(counts), max(least_short, min(most_short, 1 << max(1, v_all // 256).bit_length() - 1))))
    rank = np.full(len(counts), short, np.int64)
    best = np.argsort(-counts, kind="stable")[:short]
    rank[best] = np.arange(len(best))
    rest = rank == short
    n_tail += np.bincount(tail_of[rest], counts[rest], TAILS).astype(np.int64)
    v_tail += np.bincount(tail_of[rest], counts[rest] > 0, TAILS).astype(np.int64)
    mass = np.full(short, 0.5)
    mass[: len(best)] += counts[best]
    at = class_bounds(mass, max(32, 1 << (short.bit_length() - 1) // 2))
    model = Model(short + TAILS + 1, at, TAILS, hidden)
    model.start(np.concatenate([np.add.reduceat(mass, at[:-1]), n_tail + 0.5 * (v_tail + 1)]), mass)
    tables = sc.broadcast(Codes(counts, tail_of, rank, at, n_tail, v_tail))

    # 4. rounds of training, each from the mean of the models of the round before, by tokens (in units of 1,024)
    trainers = max(1, n_all // max(trainer_tokens, 8 * model.size))
    chunk = 1 << 13

    def train(batches):
        """Each trainer's move of the parameters, in pieces."""
        known = tables.value

        def learned():
            own, done, trainer = None, 0, None
            for (of,), codes, bounds in coded_chunks(batches, ("trainer",), "trainer"):
                if of[0] != trainer:
                    if done:
                        yield trainer, done, own
                    own, done, trainer = model_of(current.value.copy()), 0, of[0]
                    teacher = Trainer(own)
                done += teacher.fit(known.before(codes, bounds), known.klass[codes], known.within[codes], bounds)
            if done:
                yield trainer, done, own

        for trainer, done, own in learned():
            moved = own.vector - current.value
            for i, a in enumerate(range(0, own.size, chunk)):
                part = moved[a : a + chunk]
                unit = max(float(np.abs(part).max()), 1e-30) / 32767
                yield batch(_MOVES, [i], [trainer // MERGED], [-(-done // 1024)], [np.rint(part / unit).astype(np.int16).tobytes()], [unit])

    def mean(t: pa.Table) -> pa.Table:
        """Means of up to MERGED moves, the heaviest first so that their order doesn't matter."""
        rows = sorted(zip(t.column("weight").to_pylist(), t.column("unit").to_pylist(), t.column("blob").to_pylist()))
        total, weight = 0.0, sum(r[0] for r in rows)
        for w, unit, blob in rows:
            total = total + np.frombuffer(blob, np.int16) * (w * unit / weight)
        unit = max(float(np.abs(total).max()), 1e-30) / 32767
        return pa.Table.from_batches([batch(_MOVES, t.column("piece")[:1], [t.column("grp")[0].as_py() // MERGED], [weight], [np.rint(total / unit).astype(np.int16).tobytes()], [unit])])

    def model_of(vector):
        return Model(short + TAILS + 1, at, TAILS, hidden).view(vector)

    current = sc.broadcast(model.vector)
    for r in range(rounds):
        rows = coded.filter(F.col("part") == r).select(F.pmod("key", F.lit(trainers)).cast("int").alias("trainer"), "key", "blob")
        dealt = rows.repartitionById(trainers, F.col("trainer")).sortWithinPartitions("trainer", "key")
        moves, left = dealt.mapInArrow(train, _MOVES_OF), trainers
        while left:
            moves = moves.groupBy("piece", "grp").applyInArrow(mean, _MOVES_OF)
            left = (left - 1) // MERGED
        vector = current.value.copy()
        for piece, _, _, blob, unit in moves.collect():  # the parameters, once
            vector[piece * chunk : (piece + 1) * chunk] += np.frombuffer(blob, np.int16) * np.float32(unit)
        current = sc.broadcast(vector)

    # 5. scores; what rare words add comes from their buckets
    def score(batches):
        own, known = model_of(current.value), tables.value
        for (ids, rids, held), codes, bounds in coded_chunks(batches, ("id", "rid", "held_out")):
            lp = log_probability(own, known.before(codes, bounds), known.klass[codes], known.within[codes], bounds) / np.log(10) + known.share[codes]
            sums = [np.add.reduceat(x, bounds[:-1]) for x in (lp, known.logs[codes], known.met[codes])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(rids, pa.int64()), pa.array(held, pa.bool_()), pa.array(np.diff(bounds)), *map(pa.array, sums)], ["id", "rid", "held_out", "n_tokens", "lp", "logs", "seen"]
            )

    def rare(t: pa.Table) -> pa.Table:
        ids, rids, logs, seen = unpack_all([x.as_buffer() for x in t.column("blob")], np.int64, np.int64, np.float64, np.int64)
        s = np.lexsort((rids, ids))
        ids, rids, logs, seen = ids[s], rids[s], logs[s], seen[s]
        new = np.ones(len(s), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (rids[1:] != rids[:-1])
        at = np.flatnonzero(new)
        return pa.table({"id": ids[at], "rid": rids[at], "more": np.add.reduceat(logs, at), "known": np.add.reduceat(seen, at)})

    scored = coded.filter(F.col("part") >= HELD_OUT).select("id", "rid", "held_out", "blob").mapInArrow(score, "id long, rid long, held_out boolean, n_tokens long, lp double, logs double, seen long")
    # repeated rows are in the buckets each, so their part is the mean over them
    parts = counted.filter("grp >= 0").groupBy("grp").applyInArrow(rare, "id long, rid long, more double, known long")
    copies = docs.groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "rid").agg(F.count(F.lit(1)).alias("k"))
    met = scored.join(parts.join(copies, ["id", "rid"]), ["id", "rid"], "left")
    more, seen = F.coalesce(F.col("more") / F.col("k"), F.lit(0.0)), F.coalesce(F.floor(F.col("known") / F.col("k")), F.lit(0))
    base = F.col("logs") + more - F.col("n_tokens") * F.lit(float(np.log10(n_all + 0.5 * (v_all + 1))))
    return met.select(
        F.when(F.col("rid") >= 0, F.col("id")).alias("doc_id"), "held_out", "n_tokens", (F.col("seen") + seen).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("lp") + more).alias("score"),
    )


def op4_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
