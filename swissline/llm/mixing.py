"""Mixing sources to target weights by Pfair scheduling (operator 1).

The rows of each source, in a fixed random order, are cut into blocks. Block i
of a source with share w may not be scheduled before slot floor(i / w) and has
to be by slot ceil((i + 1) / w); of the released blocks the one with the
earliest deadline goes next, so that at any slot a source is less than one block
away from its share. Shares are multiples of 1 / ``slots``, the schedule of that
many slots repeats (more, up to 64 times as many, where a target is smaller than
that), and a source that has run out leaves its share to the others: no row is
dropped or doubled. A source with a target of 0, or none, comes after all others.

Defined cases: a null source is a source of its own; repeated rows are placed
each; null ids and texts are kept; further columns are carried along, but for
ones named like the three that are added, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swissline.llm.common import materialize, parallelism, table
from swissline.llm.schedule import offsets, period, phases, quotas, source_key


def pfair_table(slots: int):
    """One slot a row: which source's block is scheduled."""

    def table_of(weights: np.ndarray) -> np.ndarray:
        n = period(weights, slots, 64 * slots)
        k = quotas(weights, n)
        nxt, takes = np.zeros(len(k), np.int64), np.zeros((n, len(k)), np.int64)
        live = k > 0
        share = np.maximum(k, 1)
        for t in range(n):
            ready = live & (nxt < k) & (nxt * n // share <= t)
            deadline = np.where(ready, -(-(nxt + 1) * n // share), np.iinfo(np.int64).max)
            s = int(np.argmin(deadline))
            takes[t, s] = 1
            nxt[s] += 1
        return takes

    return table_of


def order_key(seed: int = 11):
    """The fixed random order of the rows of a source."""
    return F.xxhash64(F.lit(seed), "doc_id")


def written_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_file`` and ``_place``, by which its rows stand as they were written; rows that come from no file stand by partition."""
    try:
        return docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:
        return docs.select("*", F.lit("").alias("_file"), F.monotonically_increasing_id().alias("_place"))


def in_queues(ordered: DataFrame) -> DataFrame:
    """The rows of each source together, in the order of ``written_order``."""
    keys = (source_key(), F.col("_file"), F.col("_place"))
    return ordered.repartitionByRange(2 * parallelism(ordered.sparkSession), *keys).sortWithinPartitions(*keys)


def order_rates(ordered: DataFrame) -> dict:
    """By source key, the part of its rows that stands before the first source's end, in the order of ``written_order``: how fast the
    queues empty against each other while all of them have rows. The driver holds a number for each file and source."""
    rows = ordered.select(source_key().alias("_source"), "_file", "_place")
    ends = rows.groupBy("_source", "_file").agg(F.max("_place").alias("last"), F.count("*").alias("n"))
    last: dict[str, tuple] = {}
    for r in ends.groupBy("_source").agg(F.max(F.struct("_file", "last")).alias("at")).collect():
        last[r[0]] = tuple(r.at)
    if not last:
        return {}
    file, place = min(last.values())
    before = (F.col("_file") < file) | ((F.col("_file") == file) & (F.col("_place") <= place))
    return {r[0]: r.c / r.n for r in rows.groupBy("_source").agg(F.count_if(before).alias("c"), F.count("*").alias("n")).collect()}


def mix_sources(docs: DataFrame, weights: dict | None = None, smoothing: float = 0.5, block: int = 32, slots: int = 1024, seed: int = 11) -> DataFrame:
    """``docs`` with ``mix_block`` (number of the block in its source), ``mix_slot`` and ``mix_position`` (from 0, no gaps).

    weights: target of each source; None: its number of rows to the power ``smoothing``.
    """
    spark, added = docs.sparkSession, ("mix_block", "mix_slot", "mix_position")
    docs = docs.drop(*added)
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), source_key().alias("_source"), order_key(seed).alias("_order"))
    ordered = keyed.repartitionByRange(2 * parallelism(spark), "_source", "_order").sortWithinPartitions("_source", "_order")
    row = keyed.schema["_row"]
    schema = T.StructType([row, T.StructField("_source", T.StringType()), T.StructField("_task", T.IntegerType()), T.StructField("_local", T.LongType()), T.StructField("_one", T.LongType())])

    def number(batches):
        task, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            local = []
            for s in b.column("_source").to_pylist():
                local.append(seen.get(s, 0))
                seen[s] = local[-1] + 1
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("_row"), b.column("_source"), pa.array([task] * n, pa.int32()), pa.array(local, pa.int64()), pa.array([1] * n, pa.int64())], ["_row", "_source", "_task", "_local", "_one"]
            )

    rows, totals = offsets(materialize(ordered.mapInArrow(number, schema), "mixing"), "_one")
    names = sorted(totals)
    amount = np.array([totals[s] for s in names], np.int64)
    blocks = -(-amount // block)
    weight = amount**smoothing if weights is None else np.array([weights.get(s[1:] if s[0] == "s" else None, 0.0) for s in names], float)
    made, _, _ = phases(blocks, weight, 1, pfair_table(slots))
    ends = np.array([p.base + p.all_before(p.rounds) for p in made]).reshape(len(made), len(names))
    which = {s: i for i, s in enumerate(names)}

    def slot_of(s: int, number: np.ndarray) -> np.ndarray:
        k = np.searchsorted(ends[:, s], number, "right")
        out = np.empty(len(number), np.int64)
        for x in np.unique(k):
            p, m = made[x], k == x
            out[m] = p.first + p.round_of(s, number[m] - p.base[s])
        return out

    short = sorted((int(slot_of(i, np.array([blocks[i] - 1]))[0]), int(blocks[i] * block - amount[i])) for i in range(len(names)))
    short_at, short_by = np.array([x[0] for x in short]), np.cumsum([0, *(x[1] for x in short)])
    final = T.StructType([row, *(T.StructField(c, T.LongType()) for c in added)])

    def place(batches):
        for b in batches:
            s = np.array([which[x] for x in b.column("_source").to_pylist()], np.int64)
            rank = b.column("_before").to_numpy() + b.column("_local").to_numpy()
            number, slot = rank // block, np.empty(len(s), np.int64)
            for i in np.unique(s):
                slot[s == i] = slot_of(int(i), number[s == i])
            position = slot * block + rank % block - short_by[np.searchsorted(short_at, slot)]
            yield pa.RecordBatch.from_arrays([b.column("_row"), *map(pa.array, (number, slot, position))], ["_row", *added])

    return rows.mapInArrow(place, final).select("_row.*", *added)


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))
