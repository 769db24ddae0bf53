"""Swiss stage: standings, pressure, and Monte Carlo brackets drawn from counters, so that results don't depend on partitions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def standings(results: DataFrame, *keys: str) -> DataFrame:
    """Wins and losses of each team, in each group of ``keys``."""
    side = lambda me, won: F.struct(F.col(me).alias("team"), won.cast("int").alias("w"))
    each = results.select(*keys, F.explode(F.array(side("team1", F.col("winner") == F.col("team1")), side("team2", F.col("winner") == F.col("team2")))).alias("s")).select(*keys, "s.*")
    return each.groupBy(*keys, "team").agg(F.sum("w").alias("wins"), F.sum(1 - F.col("w")).alias("losses"))


def buchholz(results: DataFrame) -> DataFrame:
    """Sum of opponents' wins less losses."""
    s = standings(results).select(F.col("team").alias("opp"), (F.col("wins") - F.col("losses")).alias("net"))
    games = results.select(F.explode(F.array(F.struct(F.col("team1").alias("team"), F.col("team2").alias("opp")), F.struct(F.col("team2").alias("team"), F.col("team1").alias("opp")))).alias("g")).select("g.*")
    return games.join(s, "opp").groupBy("team").agg(F.sum("net").alias("buchholz"))


def record_status():
    return F.when(F.col("wins") >= 3, "advanced").when(F.col("losses") >= 3, "eliminated").otherwise("alive")


def match_type():
    """From both teams' records before the match."""
    some_null = F.col("wins1").isNull() | F.col("wins2").isNull() | F.col("losses1").isNull() | F.col("losses2").isNull()
    return F.when(some_null, "unknown").when((F.col("wins1") == 2) & (F.col("wins2") == 2), "advancement").when((F.col("losses1") == 2) & (F.col("losses2") == 2), "elimination").otherwise("standard")


def checkpoint():
    """Of a pick in a category, given the team's record."""
    w, n = F.col("wins"), F.col("losses")
    top = F.when((w >= 3) & (n == 0), "locked").when(n > 0, "broken").otherwise("alive")
    bottom = F.when((n >= 3) & (w == 0), "locked").when(w > 0, "broken").otherwise("alive")
    middle = F.when(w >= 3, F.when(n == 0, "broken").otherwise("locked")).when(n >= 3, "broken").otherwise("alive")
    return F.when(w.isNull(), "missing").when(F.col("category") == "3-0", top).when(F.col("category") == "0-3", bottom).otherwise(middle)


def _pairs(order: list[int], met: list[set]) -> list[tuple[int, int]] | None:
    """Best against worst without a rematch, by backtracking."""
    if not order:
        return []
    a = order[0]
    for b in reversed(order[1:]):
        if b not in met[a]:
            rest = _pairs([x for x in order if x not in (a, b)], met)
            if rest is not None:
                return [(a, b), *rest]
    return None


def bracket(p1: np.ndarray, p3: np.ndarray, draw) -> list[tuple[int, int]]:
    """(wins, losses) of each seed. p1, p3: probability that row beats column in a best of one or three; draw(round, i) in [0, 1)."""
    n = len(p1)
    wins, losses, met = [0] * n, [0] * n, [set() for _ in range(n)]
    net = lambda t: sum(wins[o] - losses[o] for o in met[t])
    for rnd in range(10):
        alive = [t for t in range(n) if wins[t] < 3 and losses[t] < 3]
        if not alive:
            break
        if rnd == 0:
            games = [(i, i + n // 2) for i in range(n // 2)]
        else:
            games, floater = [], []
            for record in sorted({(wins[t], losses[t]) for t in alive}, key=lambda r: (-r[0], r[1])):
                order = floater + sorted((t for t in alive if (wins[t], losses[t]) == record), key=lambda t: (-net(t), t))
                floater = [order.pop()] if len(order) % 2 else []
                games += _pairs(order, met) or list(zip(order[: len(order) // 2], reversed(order)))
        for i, (a, b) in enumerate(games):
            decisive = 2 in (wins[a], losses[a], wins[b], losses[b])
            first = draw(rnd, i) < (p3 if decisive else p1)[a, b]
            w, x = (a, b) if first else (b, a)
            wins[w] += 1
            losses[x] += 1
            met[a].add(b)
            met[b].add(a)
    return list(zip(wins, losses))


def simulate(spark: SparkSession, strengths: list[float], simulations: int, seed: int = 13) -> DataFrame:
    """sim, seed_no, wins, losses. strengths: one for each seed; they make the probability tables sent with the tasks."""
    s = np.array(strengths)
    p1 = np.clip(0.5 + (s[:, None] - s[None, :]) * 0.28 / 0.35, 0.06, 0.94)
    p3 = p1 * p1 * (3 - 2 * p1)

    def run(batches):
        for b in batches:
            out = []
            for sim in b.column(0).to_pylist():
                u = np.random.Generator(np.random.Philox(key=[seed, sim])).random((10, len(s) // 2))
                out += [(sim, t, w, n) for t, (w, n) in enumerate(bracket(p1, p3, lambda r, i: u[r, i]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["sim", "seed_no", "wins", "losses"])

    return spark.range(simulations).mapInArrow(run, "sim long, seed_no long, wins long, losses long")


def edge_probability(first: Column, second: Column) -> Column:
    """Win probability from two strengths, never below 6 or above 94 per cent."""
    return F.least(F.greatest(0.5 + (first - second) * 0.28 / 0.35, F.lit(0.06)), F.lit(0.94))


def outcome_shares(samples: DataFrame) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    w, n = F.col("wins"), F.col("losses")
    return samples.groupBy("seed_no").agg(share((w == 3) & (n == 0)).alias("p_30"), share((w == 3) & (n > 0)).alias("p_advance"), share((n == 3) & (w == 0)).alias("p_03"), F.count("*").alias("n"))


def ticket_hits(samples: DataFrame, ticket: DataFrame, needed: int = 5) -> DataFrame:
    """How often a ticket (category, seed_no) has so many hits, and whether that is enough."""
    w, n = F.col("wins"), F.col("losses")
    hit = F.when(F.col("category") == "3-0", (w == 3) & (n == 0)).when(F.col("category") == "0-3", (n == 3) & (w == 0)).otherwise((w == 3) & (n > 0))
    hits = samples.join(ticket, "seed_no").groupBy("sim").agg(F.count_if(hit).alias("hits"))
    return hits.groupBy("hits").agg(F.count("*").alias("n")).withColumn("passes", (F.col("hits") >= needed).cast("int"))


def playoff(teams: DataFrame, picks: DataFrame, rounds: int = 3) -> DataFrame:
    """Knockout brackets filled from picks: each slot's two teams and winner. The last pick of a slot counts, and only if it names one of
    the slot's teams; what follows from no valid pick is null. teams: bracket, place from 0, team; picks: bracket, round from 1, slot, winner, seq."""
    last = picks.groupBy("bracket", "round", "slot").agg(F.max_by("winner", "seq").alias("picked"))
    now, out = teams.select("bracket", "place", "team"), []
    for r in range(1, rounds + 1):
        side = lambda n: F.max(F.when(F.col("place") % 2 == n, F.col("team")))
        games = now.groupBy("bracket", F.expr("place div 2").alias("slot")).agg(side(0).alias("team1"), side(1).alias("team2"))
        met = games.join(last.filter(F.col("round") == r).drop("round"), ["bracket", "slot"], "left")
        valid = (F.col("picked") == F.col("team1")) | (F.col("picked") == F.col("team2"))
        met = met.select("bracket", F.lit(r).cast("long").alias("round"), "slot", "team1", "team2", F.when(valid, F.col("picked")).alias("winner"))
        out.append(met)
        now = met.select("bracket", F.col("slot").alias("place"), F.col("winner").alias("team"))
    return reduce(DataFrame.unionByName, out)


def pruned_picks(bracket: DataFrame, picks: DataFrame) -> DataFrame:
    """The picks that the filled bracket has no use for."""
    used = bracket.filter("winner is not null").select("bracket", "round", "slot", "winner")
    return picks.join(used, ["bracket", "round", "slot", "winner"], "left_anti")
