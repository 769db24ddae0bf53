"""Quality rules on repetition, by a suffix array of each text's words (operator 5).

The suffixes of a batch of texts are ranked by prefix doubling, texts kept
apart; the ranks of every doubling give the longest common prefix of suffixes
that are neighbours in the array. A word position starts a repeated substring
as long as the larger of its two neighbouring prefixes, which is the value of
the innermost prefix interval that holds it. The spans of these maximal repeats,
from ``least`` words on, are united. A text fails if they cover more than
``most_covered`` of its words or if one repeat is longer than ``longest`` words
and than ``longest_share`` of the text.

Defined cases: a null text has no words; texts without words fail by the base
rule; repeated rows and a null doc_id are kept as they are; other columns are
carried along, but for _q, _base_failed and _kept, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swissline.llm.common import Poly, mix, rows_of, slices, table, words

_BYTES = Poly(501)
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_START = (np.arange(256) & 0xC0) != 0x80
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

COLUMNS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_covered_words longest_repeat".split()


def repeats(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Length of the longest substring that starts at each place and occurs twice or more in its row."""
    n = len(value)
    if not n:
        return np.zeros(0, np.int64)
    row = rows_of(bounds)
    end = bounds[1:][row]
    order = np.lexsort((value, row))
    new = np.ones(n, bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (row[order][1:] != row[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank], 1
    while True:
        alone = new & np.append(new[1:], True)
        slot = np.flatnonzero(~alone)
        if not len(slot):
            break
        i = order[slot]
        nxt = np.where(i + step < end[i], rank[np.minimum(i + step, n - 1)], -1)
        s = np.lexsort((nxt, rank[i]))
        i, nxt, old = i[s], nxt[s], rank[i][s]
        order[slot] = i
        fresh = np.ones(len(i), bool)
        fresh[1:] = (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])
        new[slot] = fresh
        rank = rank.copy()
        rank[i] = np.maximum.accumulate(np.where(fresh, slot, 0))
        levels.append(rank)
        step *= 2
    a, b = order[:-1], order[1:]
    common = np.zeros(n + 1, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b, have = a[live], b[live], np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + have, b + have
        ok = (x < end[a]) & (y < end[b])
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        have[ok] += 1 << k
    common[live + 1] = have
    out = np.empty(n, np.int64)
    out[order] = np.maximum(common[:-1], common[1:])
    return out


def _covered(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + size, -1)
    return np.cumsum(step[:-1]) > 0


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def figures(buf: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    starts, ends, bounds = words(buf, offs)
    size = repeats(mix(_BYTES.spans(_BYTES.prefix(buf), starts, ends)), bounds)
    n = len(starts)
    three, long_ = np.flatnonzero(size >= 3), np.flatnonzero(size >= least)
    again = _per_row(_covered(three, np.full(len(three), 3), n), bounds)
    covered = _per_row(_covered(long_, size[long_], n), bounds)
    longest = np.zeros(len(offs) - 1, np.int64)
    if n:
        np.maximum.at(longest, rows_of(bounds), size)
    dup = []
    raw = buf.tobytes()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    return np.diff(bounds), _per_row(_START[buf] & ~_SPACE[buf], offs), _per_row(_SYMBOL[buf], offs), np.array(dup), again, covered, longest


def measure(docs: DataFrame, least: int = 6) -> DataFrame:
    """All columns of ``docs`` with ``_q``: a struct of COLUMNS."""
    names = COLUMNS

    def run(batches):
        for b in batches:
            parts = [figures(buf, offs, least) for _, _, buf, offs in slices(b.column("text"))]
            cols = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts)] if parts else [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(cols, names)], [*b.schema.names, "_q"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_q", T.StructType([T.StructField(x, T.LongType()) for x in names]))]))


def judged(docs: DataFrame, least: int = 6, most_covered: float = 0.3, longest: int = 40, longest_share: float = 0.1) -> DataFrame:
    """``docs`` with the struct ``_q`` of figures, base_failed and kept."""
    q = measure(docs.drop("_q", "_base_failed", "_kept"), least)
    base = (F.col("_q.n_words") < 50) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))
    repetitive = (F.col("_q.n_covered_words") > most_covered * F.col("_q.n_words")) | (
        (F.col("_q.longest_repeat") > longest) & (F.col("_q.longest_repeat") > longest_share * F.col("_q.n_words"))
    )
    return q.withColumn("_base_failed", base).withColumn("_kept", ~base & ~repetitive)


def op5_quality_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "_q.*", F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))
