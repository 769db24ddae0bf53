"""Periodic schedules over source streams, and numbering rows within their source.

A schedule is a list of phases. In a phase a fixed set of sources is served by a
short table that repeats; what a source has got after any round is then a closed
form, so each task places its own rows without seeing others. A phase ends when
one of its sources can't fill its next share. The driver only holds totals by
source and one table a phase.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swissline.llm.common import materialize


@dataclass
class Phase:
    first: int  # round
    rounds: int
    base: np.ndarray  # what each source has got before it
    got: np.ndarray  # (period + 1, sources): within a period, before each round

    @property
    def period(self) -> int:
        return len(self.got) - 1

    def before(self, source: int, rounds):
        """What a source has got in this phase before its round ``rounds``."""
        q, r = np.divmod(rounds, self.period)
        return q * self.got[-1, source] + self.got[r, source]

    def all_before(self, rounds: int) -> np.ndarray:
        q, r = divmod(rounds, self.period)
        return q * self.got[-1] + self.got[r]

    def round_of(self, source: int, unit):
        """Round in this phase that takes the unit-th unit (from 0) of a source."""
        per = self.got[-1, source]
        q, r = np.divmod(unit, per)
        return q * self.period + np.searchsorted(self.got[:, source], r, "right") - 1


def quotas(weights: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers in proportion to the weights, one at least where a weight is positive, that add up to ``total``."""
    live = weights > 0
    ideal = weights / weights.sum() * total
    k = np.where(live, np.maximum(1, np.floor(ideal)), 0).astype(np.int64)
    while (d := total - int(k.sum())) != 0:
        if d > 0:
            k[np.argsort(-np.where(live, ideal - k, -np.inf), kind="stable")[: min(d, int(live.sum()))]] += 1
        else:
            can = np.flatnonzero(k > 1)
            k[can[np.argsort((ideal - k)[can], kind="stable")[: min(-d, len(can))]]] -= 1
    return k


def period(weights: np.ndarray, least: int, most: int) -> int:
    """Slots of a schedule in which the smallest positive share is one slot or more, a power of two times ``least``, up to ``most``."""
    share = weights[weights > 0].min(initial=weights.sum()) / weights.sum()
    n = least
    while n < most and n * share < 1:
        n *= 2
    return max(n, int((weights > 0).sum()))


def phases(totals: np.ndarray, weights: np.ndarray, capacity: int, table) -> tuple[list[Phase], np.ndarray, int]:
    """Phases until no full round is left; also what each source has got by then, and the number of rounds.

    table(quota weights of live sources) -> (period, sources) takes of each round, rows adding up to ``capacity``.
    """
    got, first, out = np.zeros(len(totals), np.int64), 0, []
    while True:
        rest = totals - got
        if rest.sum() < capacity:
            return out, got, first
        live = np.where(rest > 0, weights, 0.0)
        takes = table(live if live.any() else (rest > 0).astype(float))  # sources without a target come when all others have run out
        phase = Phase(first, 0, got.copy(), np.vstack([np.zeros(len(totals), np.int64), np.cumsum(takes, 0)]))
        lo, hi = 0, int(rest.sum() // capacity)
        while lo < hi:
            mid = (lo + hi + 1) >> 1
            if (phase.all_before(mid) <= rest).all():
                lo = mid
            else:
                hi = mid - 1
        if lo == 0:  # one round in which a source runs dry: what it leaves goes round the others
            take = np.minimum(takes[0], rest)
            left = capacity - int(take.sum())
            for s in np.argsort(-(rest - take), kind="stable"):
                more = min(left, int(rest[s] - take[s]))
                take[s] += more
                left -= more
            phase = Phase(first, 0, got.copy(), np.vstack([np.zeros_like(take), take]))
            lo = 1
        phase.rounds = lo
        out.append(phase)
        got = got + phase.all_before(lo)
        first += lo


def offsets(numbered: DataFrame, size: str) -> tuple[DataFrame, dict]:
    """Adds ``_before``: how much of its source stands before a row's task, from rows (_task, _source, size); and totals by source."""
    sums = materialize(numbered.groupBy("_task", "_source").agg(F.sum(size).alias("_sum")), "sums")
    w = Window.partitionBy("_source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(sums.select("_task", "_source", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before")), "before")
    totals = {r[0]: r[1] for r in sums.groupBy("_source").agg(F.sum("_sum")).collect()}
    return numbered.join(before, ["_task", "_source"]), totals


def source_key(column: str = "source"):
    """A null source is a queue of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("n"))
