"""Ratings of teams.

Elo and Glicko-2 depend on the order of all matches, but no task ever holds that order. Elo's ratings are the fixed point of running
sums: each match moves both teams by what their ratings before it say, and a team's rating is its start plus the moves of its earlier
matches. Starting from any ratings, sums and moves are computed again and again for all matches at once until nothing changes; each
round settles at least the next match of every team, and in practice about twenty rounds settle all of a stretch of days in which no
team plays more than some hundred matches. Glicko-2 goes day by day, as its periods do: a day is one join of its matches with the
state of the teams and one aggregation by team.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swissline.operators.durable import stored

# fixed values: K by tier
TIER_K = {"S": 32.0, "A": 20.0, "B": 14.0, "C": 10.0}
OTHER_K = 24.0


def known(winner: str = "winner") -> Column:
    """Matches that move ratings: two different teams, one of which has won."""
    return F.coalesce((F.col("team1") != F.col("team2")) & ((F.col(winner) == F.col("team1")) | (F.col(winner) == F.col("team2"))), F.lit(False))


def sides(rows: DataFrame, first: dict[str, Column], second: dict[str, Column], *keep: str) -> DataFrame:
    """Two rows for each of ``rows``: what is kept, and the columns of either team."""
    both = F.array(F.struct(*(c.alias(k) for k, c in first.items())), F.struct(*(c.alias(k) for k, c in second.items())))
    return rows.select(*keep, F.inline(both))


def stretches(matches: DataFrame, most: int) -> list[tuple[int, int]]:
    """First and last day of runs of days in which no team has more than ``most`` matches; a day with more is a run of its own. The driver holds a number for each day."""
    each = sides(matches, {"team": F.col("team1")}, {"team": F.col("team2")}, "day").groupBy("day", "team").count()
    out, n = [], 0
    for day, count in each.groupBy("day").agg(F.max("count")).orderBy("day").collect():
        if out and n + count <= most:
            out[-1] = out[-1][0], day
            n += count
        else:
            out.append((day, day))
            n = count
    return out


def elo_k() -> Column:
    k = F.lit(OTHER_K)
    for tier, x in TIER_K.items():
        k = F.when(F.col("tier") == tier, x).otherwise(k)
    return k


def signed_k() -> Column:
    """K of a match, below zero where the second team won; null moves nothing."""
    return F.when(known() & (F.col("winner") == F.col("team1")), elo_k()).when(known(), -elo_k())


def elo_move(elo1: Column, elo2: Column) -> Column:
    """What the first team wins, and the second loses, by a match with column k (``signed_k``)."""
    k = F.col("k")
    return F.coalesce(F.abs(k) * (F.when(k > 0, 1.0).otherwise(0.0) - 1 / (1 + F.pow(F.lit(10.0), (elo2 - elo1) / 400))), F.lit(0.0))


_MATCH = ("match_id", "day", "team1", "team2", "k", "start1", "start2")


def _round(rows: DataFrame, last: bool) -> DataFrame:
    """One round: the ratings before each match from the moves that the last ratings give; with the change where ``last``. Rows go to
    their team with what its sum needs, and back to their match with what the next round needs; k goes with the first side alone."""
    move = elo_move(F.col("elo1"), F.col("elo2"))
    was = lambda n: {"was": F.col(f"elo{n}")} if last else {}
    side = lambda n, sign, k: {"side": F.lit(n).cast("byte"), "team": F.col(f"team{n}"), "start": F.col(f"start{n}"), "move": sign * move, "k": k, **was(n)}
    each = sides(rows, side(1, F.lit(1.0), F.col("k")), side(2, F.lit(-1.0), F.lit(None).cast("double")), "match_id", "day")
    before = Window.partitionBy("team").orderBy("day", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("elo", F.col("start") + F.coalesce(F.sum("move").over(before), F.lit(0.0)))
    change = {"change": F.abs(F.col("elo") - F.col("was"))} if last else {}
    each = each.select("match_id", "day", "side", "team", "start", "k", "elo", *(c.alias(k) for k, c in change.items()))
    other = lambda c: F.lead(c).over(Window.partitionBy("match_id").orderBy("side"))
    both = each.select("side", "match_id", "day", F.col("team").alias("team1"), other("team").alias("team2"), "k", F.col("start").alias("start1"), other("start").alias("start2"),
        F.col("elo").alias("elo1"), other("elo").alias("elo2"), *(F.greatest(k, other(k)).alias(k) for k in change))
    return both.filter("side = 1").drop("side")


def elo(matches: DataFrame, base: float = 1500.0, most: int = 200, rounds: int = 4, tolerance: float = 1e-9) -> DataFrame:
    """Ratings of both teams before each match. A match without a known winner moves nothing.

    most: matches of a team in one stretch of days; the ratings after a stretch are where the next one starts. rounds: of each job.
    """
    narrow = stored(matches.select("match_id", "day", "team1", "team2", signed_k().alias("k")), "elo-matches")
    found, state = [], None
    for lo, hi in stretches(narrow, most):
        rows = narrow.filter(F.col("day").between(lo, hi))
        for n in (1, 2):
            if state is None:
                rows = rows.withColumn(f"start{n}", F.lit(base))
            else:
                rows = rows.join(state.select(F.col("team").alias(f"team{n}"), F.col("elo").alias(f"start{n}")), f"team{n}", "left").fillna(base, [f"start{n}"])
        rows = rows.select(*_MATCH, F.col("start1").alias("elo1"), F.col("start2").alias("elo2"))
        change = math.inf
        while change > tolerance:
            for i in range(rounds):
                rows = _round(rows, i == rounds - 1)
            rows = stored(rows, "elo")
            change = rows.agg(F.max("change")).first()[0] or 0.0
        found.append(rows)
        after = _after(rows)
        if state is not None:  # teams that didn't play keep their rating
            after = after.unionByName(state.join(after, "team", "left_anti"))
        state = stored(after, "elo-state")
    empty = narrow.limit(0).select("match_id", F.lit(0.0).alias("elo1"), F.lit(0.0).alias("elo2"))
    return reduce(DataFrame.union, (r.select("match_id", "elo1", "elo2") for r in found), empty)


def _after(rows: DataFrame) -> DataFrame:
    """Each team's rating after its last match of ``rows``."""
    move = elo_move(F.col("elo1"), F.col("elo2"))
    each = sides(rows, {"team": F.col("team1"), "elo": F.col("elo1") + move}, {"team": F.col("team2"), "elo": F.col("elo2") - move}, "day", "match_id")
    return each.groupBy("team").agg(F.max_by("elo", F.struct("day", "match_id")).alias("elo"))


def final_elo(matches: DataFrame, before: DataFrame) -> DataFrame:
    """Each team's rating after its last match, from the ratings before it. before: match_id, elo1, elo2."""
    return _after(matches.select("match_id", "day", "team1", "team2", signed_k().alias("k")).join(before, "match_id"))


def margin_weight(difference: Column, gap: Column, alpha: float = 1.0, beta: float = 2.2, gamma: float = 0.001) -> Column:
    """Weight of a result by its margin, less the larger the rating gap was; 1 without a margin."""
    return F.when(difference > 0, alpha * F.log1p(difference) * beta / (beta + gamma * F.abs(gap))).otherwise(F.lit(1.0))


def round_difference(score1: Column, score2: Column) -> Column:
    """Null where a score is missing or nothing was played."""
    return F.when(score1 + score2 != 0, F.abs(score1 - score2))


def pair_games(matches: DataFrame, *keys: str) -> DataFrame:
    lo, hi = F.least("team1", "team2"), F.greatest("team1", "team2")
    known = matches.filter((F.col("winner") == F.col("team1")) | (F.col("winner") == F.col("team2")))
    return known.groupBy(*keys, lo.alias("lo"), hi.alias("hi")).agg(F.count("*").alias("games"), F.count_if(F.col("winner") == F.least("team1", "team2")).alias("lo_wins"))


def bradley_terry(matches: DataFrame, *keys: str, ridge: float = 1.0, sweeps: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """Mean-centred log strengths, of each group of ``keys``; only pair counts reach the iteration."""
    return fit_pairs(pair_games(matches, *keys), *keys, ridge=ridge, sweeps=sweeps, tolerance=tolerance)


def rolling_bradley_terry(matches: DataFrame, ridge: float = 1.0) -> DataFrame:
    """Strengths of both teams before each match, fitted on the days before: one fit for each day, all days at once. Pair counts are
    summed up over days first; a sum stands from the day after it changed to the day of the next change. Unknown teams are 0."""
    days = matches.select("day").distinct().withColumn("k", F.row_number().over(Window.orderBy("day")))  # distinct days only
    pair = Window.partitionBy("lo", "hi").orderBy("k")
    sums = pair_games(matches, "day").join(days, "day").select("lo", "hi", "k", F.sum("games").over(pair).alias("games"), F.sum("lo_wins").over(pair).alias("lo_wins"), F.lead("k").over(pair).alias("until"))
    last = days.agg(F.max("k").alias("end"))
    held = sums.join(F.broadcast(last)).withColumn("until", F.coalesce("until", "end")).filter("until > k")  # one row
    before = held.select("lo", "hi", "games", "lo_wins", F.explode(F.sequence(F.col("k") + 1, "until")).alias("k")).join(days, "k").drop("k")
    theta = fit_pairs(before, "day", ridge=ridge)
    out = matches.select("match_id", "day", "team1", "team2")
    for n in (1, 2):
        out = out.join(theta.select("day", F.col("team").alias(f"team{n}"), F.col("theta").alias(f"theta{n}")), ["day", f"team{n}"], "left")
    return out.fillna(0.0, ["theta1", "theta2"]).select("match_id", "theta1", "theta2", (F.col("theta1") - F.col("theta2")).alias("theta_diff"))


def bradley_terry_by_map(matches: DataFrame, ridge: float = 4.0, pool: tuple[str, ...] = ()) -> DataFrame:
    """Strengths on each map, drawn to the strengths over all maps; a map of the pool without games has those."""
    whole = bradley_terry(matches)
    own = fit_pairs(pair_games(matches, "map"), "map", ridge=ridge, prior=whole)
    if not pool:
        return own
    unplayed = whole.withColumn("map", F.explode(F.array(*map(F.lit, pool)))).join(matches.select("map").distinct(), "map", "left_anti")
    return own.unionByName(unplayed)


CHUNK = 1 << 19  # pairs whose places are looked up and whose sums are formed at a time


def fit_pairs(pairs: DataFrame, *keys: str, ridge: float = 1.0, sweeps: int = 200, tolerance: float = 1e-6, prior: DataFrame | None = None) -> DataFrame:
    """Strengths from the counts of each pair (lo, hi, games, lo_wins), of each group of ``keys``; prior: log strengths (team, theta) to draw to, else 0.
    A group is read batch by batch; its task keeps twelve bytes a pair (places of the two teams and games) and a few numbers a team."""
    pairs = pairs.select(*keys, "lo", "hi", F.col("games").cast("int"), F.col("lo_wins").cast("int"))
    drawn = prior is not None
    if drawn:
        for side in ("lo", "hi"):
            pairs = pairs.join(prior.select(F.col("team").alias(side), F.col("theta").alias(f"{side}_prior")), side, "left")
        pairs = pairs.fillna(0.0, ["lo_prior", "hi_prior"])
    def fit(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teams, held = Places(), []
        for lo, hi, games, lo_wins, *priors in _chunks(batches, ["lo", "hi", "games", "lo_wins", *(["lo_prior", "hi_prior"] if drawn else [])]):
            i, j = teams.of(lo), teams.of(hi)
            teams.wins += np.bincount(i, lo_wins, len(teams.wins)) + np.bincount(j, games - lo_wins, len(teams.wins))
            if drawn:
                teams.prior[i], teams.prior[j] = priors
            held.append((i, j, games))
        wins, n = teams.wins, len(teams.wins)
        pi = prior = np.exp(teams.prior)
        for _ in range(sweeps):
            under = np.full(n, ridge)
            for i, j, games in held:
                share = games / (pi[i] + pi[j])
                under += np.bincount(i, share, n) + np.bincount(j, share, n)
            new = (wins + ridge * prior) / under
            new /= np.exp(np.log(new).mean())
            done = np.abs(np.log(new / pi)).max() < tolerance
            pi = new
            if done:
                break
        theta = np.log(pi)
        theta -= theta.mean()
        for at in range(0, n, CHUNK):
            names = pa.array(teams.names[at : at + CHUNK])
            yield pa.RecordBatch.from_arrays([*(pa.repeat(k, len(names)) for _, k in zip(keys, group)), names, pa.array(theta[at : at + CHUNK])], [*keys, "team", "theta"])

    kinds = "".join(f"{k} {pairs.schema[k].dataType.simpleString()}, " for k in keys)
    grouped = pairs.groupBy(*keys) if keys else pairs.withColumn("g", F.lit(1)).groupBy("g")
    return grouped.applyInArrow(fit, f"{kinds}team long, theta double")


def _chunks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of ``batches`` as arrays of about ``CHUNK`` rows, copied so that no batch is kept."""
    waiting, rows = [], 0
    joined = lambda: [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in waiting]) for c in columns]
    for b in batches:
        waiting.append(b)
        rows += b.num_rows
        if rows >= CHUNK:
            yield joined()
            waiting, rows = [], 0
    if rows:
        yield joined()


class Places:
    """Places of names in the order in which they were first met, and what is known of each: wins and prior."""

    def __init__(self) -> None:
        self.names = np.zeros(0, np.int64)
        self.wins, self.prior = np.zeros(0), np.zeros(0)
        self._sorted, self._place = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def of(self, x: np.ndarray) -> np.ndarray:
        met = np.unique(x)
        met = met[~np.isin(met, self._sorted, assume_unique=True)]
        if len(met):
            new = np.arange(len(self.names), len(self.names) + len(met), dtype=np.int32)
            self.names = np.concatenate([self.names, met])
            self.wins, self.prior = (np.concatenate([a, np.zeros(len(met))]) for a in (self.wins, self.prior))
            names, places = np.concatenate([self._sorted, met]), np.concatenate([self._place, new])
            order = np.argsort(names, kind="stable")
            self._sorted, self._place = names[order], places[order]
        return self._place[np.searchsorted(self._sorted, x)]


# ---------------------------------------------------------------- Glicko-2
SCALE, CENTRE = 173.7178, 1500.0


def attenuation(phi: Column) -> Column:
    return 1 / F.sqrt(1 + 3 * phi * phi / F.lit(math.pi**2))


def volatility(delta2: Column, phi2: Column, v: Column, sigma: Column, tau: float, steps: int = 48) -> Column:
    """The new volatility: the zero of the period's equation in the logarithm of the variance, halved in on between two points of which
    the lower is not below zero and the upper not above it."""
    a = 2 * F.ln(sigma)
    far = F.when(delta2 > phi2 + v, delta2 - phi2 - v)  # both may be infinite
    other = F.when(far.isNotNull(), F.ln(far)).otherwise(a - tau * math.ceil(max(1.0, tau / 2)))

    def f(x: Column) -> Column:
        e = F.exp(x)
        return e * (delta2 - phi2 - v - e) / (2 * (phi2 + v + e) * (phi2 + v + e)) - (x - a) / F.lit(tau**2)

    def halved(at: Column, _: Column) -> Column:
        mid = (at.lo + at.hi) / 2
        below = f(mid) >= 0
        return F.struct(F.when(below, mid).otherwise(at.lo).alias("lo"), F.when(below, at.hi).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.least(a, other).alias("lo"), F.greatest(a, other).alias("hi")), halved, lambda at: F.exp((at.lo + at.hi) / 4))


def contributions(mu: Column, other_mu: Column, other_phi: Column, score: Column, weight: Column) -> tuple[Column, Column]:
    """What one game adds to a team's precision and to its gain."""
    g = attenuation(other_phi)
    e = 1 / (1 + F.exp(-g * (mu - other_mu)))
    return weight * g * g * e * (1 - e), weight * g * (score - e)


def advanced(sums: DataFrame, tau: float = 0.5) -> DataFrame:
    """``sums`` (mu, phi, sigma before a period, i and d: sums of contributions) with the three after it, on the inner scale; games without
    weight only widen. Each value is a step of its own: it is computed once however often the next one uses it. Upsets beyond all doubles make
    the volatility infinite; a period without precision after that stays as wide, and nothing is divided by its zero."""
    mu, phi, sigma, i, d = (F.col(c) for c in ("mu", "phi", "sigma", "i", "d"))
    sums = sums.withColumn("_v", F.when(i > 0, 1 / i)).withColumn("_delta2", F.when(i > 0, d / i * d / i))
    sums = sums.withColumn("sigma", F.when(i > 0, volatility(F.col("_delta2"), phi * phi, F.col("_v"), sigma, tau)).otherwise(sigma))
    sums = sums.withColumn("_wide", phi * phi + F.col("sigma") * F.col("sigma")).withColumn("_phi2", F.when(i > 0, 1 / (1 / F.col("_wide") + i)).otherwise(F.col("_wide")))
    return sums.withColumns({"mu": mu + F.when(i > 0, F.col("_phi2") * d).otherwise(0.0), "phi": F.sqrt("_phi2")}).drop("_v", "_delta2", "_wide", "_phi2")


_STATE = ("mu", "phi", "sigma", "last")


def _widened(phi: Column, sigma: Column, idle: Column, most: float) -> Column:
    """Deviation after ``idle`` periods without a game, never over ``most``; without such a period it stays, however large the volatility."""
    return F.least(F.lit(most), F.when(idle > 0, F.sqrt(phi * phi + sigma * sigma * idle)).when(idle <= 0, phi))


def glicko_history(matches: DataFrame, rd: float = 350.0, sigma: float = 0.06, tau: float = 0.5, margin: tuple[float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(team, last, mu, phi, sigma) after each period in which a team played, on the inner scale, and the periods (day, period).

    A period is a day with matches. Matches without a known winner move nothing. margin: alpha, beta and gamma of the weight of a result by
    its round difference (score1, score2). The state is written after every day; the driver holds the days.
    """
    scores = ["score1", "score2"] if margin else []
    spark, top = matches.sparkSession, rd / SCALE
    days = [r[0] for r in matches.select("day").distinct().orderBy("day").collect()]
    periods = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "day long, period long")
    narrow = matches.filter(known()).select("day", "team1", "team2", (F.col("winner") == F.col("team1")).cast("double").alias("won"), *scores)
    narrow = stored(narrow.join(F.broadcast(periods), "day"), "glicko-matches", "period")  # a row for each day
    kind = narrow.schema["team1"].dataType.simpleString()
    state = spark.createDataFrame([], f"team {kind}, mu double, phi double, sigma double, last long")

    # columns of a day's step; they are the same every day, so its code is compiled once
    own = {n: [F.col("team").alias(f"team{n}"), *(F.col(c).alias(f"{c}{n}") for c in _STATE)] for n in (1, 2)}
    now = {}
    for n in (1, 2):
        now[f"mu{n}"], now[f"sigma{n}"] = F.coalesce(F.col(f"mu{n}"), F.lit(0.0)), F.coalesce(F.col(f"sigma{n}"), F.lit(sigma))
        now[f"phi{n}"] = F.coalesce(_widened(F.col(f"phi{n}"), F.col(f"sigma{n}"), F.col("period") - F.col(f"last{n}") - 1, top), F.lit(top))
    weight = F.lit(1.0)
    if margin:
        weight = margin_weight(round_difference(F.col("score1").cast("double"), F.col("score2").cast("double")), SCALE * (F.col("mu1") - F.col("mu2")), *margin)

    def side(n: int, m: int, score: Column) -> dict[str, Column]:
        i, d = contributions(F.col(f"mu{n}"), F.col(f"mu{m}"), F.col(f"phi{m}"), score, F.col("weight"))
        return {"team": F.col(f"team{n}"), "i": i, "d": d}

    first, second = side(1, 2, F.col("won")), side(2, 1, 1 - F.col("won"))
    kept = F.struct(*_STATE).alias("held")
    sums = [F.max("held").alias("held"), F.sum("i").alias("i"), F.sum("d").alias("d"), F.max("period").alias("period")]
    phi = F.coalesce(_widened(F.col("held.phi"), F.col("held.sigma"), F.col("period") - F.col("held.last") - 1, top), F.lit(top))
    start = [F.col("team"), "period", "held", "i", "d", F.coalesce("held.mu", F.lit(0.0)).alias("mu"), phi.alias("phi"), F.coalesce("held.sigma", F.lit(sigma)).alias("sigma")]
    result = [F.col("team"), F.col("mu"), F.least("phi", F.lit(top)).alias("phi"), F.col("sigma"), F.col("period").alias("last")]
    played, idle = F.col("period").isNotNull(), [F.col("team"), *(F.col("held")[c].alias(c) for c in _STATE)]

    log = []
    for period in range(len(days)):
        rows = narrow.filter(F.col("period") == period)
        for n in (1, 2):
            rows = rows.join(state.select(own[n]), f"team{n}", "left")
        games = sides(rows.withColumns(now).withColumn("weight", weight), first, second, "period")
        both = games.unionByName(state.select("team", kept), allowMissingColumns=True).groupBy("team").agg(*sums)
        state = stored(advanced(both.select(start), tau).select(*(F.when(played, x).otherwise(y).alias(c) for c, x, y in zip(("team", *_STATE), result, idle))), "glicko-state")
        log.append(state.filter(F.col("last") == period))
    log = reduce(DataFrame.union, log, state.limit(0))
    return log.select("team", "last", "mu", "phi", "sigma"), periods


def glicko(matches: DataFrame, rd: float = 350.0, sigma: float = 0.06, tau: float = 0.5, margin: tuple[float, float, float] | None = None) -> DataFrame:
    """Rating and deviation of both teams before each match; idle teams widen each period."""
    log, periods = glicko_history(matches, rd, sigma, tau, margin)
    top = rd / SCALE
    rows = matches.select("match_id", "day", "team1", "team2").join(F.broadcast(periods), "day")  # a row for each day
    each = sides(rows, {"side": F.lit(1), "team": F.col("team1")}, {"side": F.lit(2), "team": F.col("team2")}, "match_id", "period")
    # a team's matches and states in one order: a state counts from the period after it
    line = each.unionByName(log.select("team", (F.col("last") + 1).alias("period"), F.struct("last", "mu", "phi", "sigma").alias("_s")), allowMissingColumns=True)
    before = Window.partitionBy("team").orderBy("period").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = line.withColumn("_s", F.last("_s", ignorenulls=True).over(before)).filter("match_id is not null")
    mu = CENTRE + SCALE * F.coalesce(F.col("_s.mu"), F.lit(0.0))
    phi = SCALE * F.coalesce(_widened(F.col("_s.phi"), F.col("_s.sigma"), F.col("period") - F.col("_s.last") - 1, top), F.lit(top))
    of = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)))
    return held.select("match_id", "side", mu.alias("mu"), phi.alias("rd")).groupBy("match_id").agg(of(1, "mu").alias("mu1"), of(1, "rd").alias("rd1"), of(2, "mu").alias("mu2"), of(2, "rd").alias("rd2"))


def final_glicko(matches: DataFrame, rd: float = 350.0, sigma: float = 0.06, tau: float = 0.5, margin: tuple[float, float, float] | None = None) -> DataFrame:
    """team, mu, rd, sigma at the end of the history."""
    log, periods = glicko_history(matches, rd, sigma, tau, margin)
    latest = log.groupBy("team").agg(F.max(F.struct("last", "mu", "phi", "sigma")).alias("_s"))
    end = periods.agg(F.max("period").alias("_end"))
    phi = _widened(F.col("_s.phi"), F.col("_s.sigma"), F.col("_end") - F.col("_s.last"), rd / SCALE)
    return latest.join(F.broadcast(end)).select("team", (CENTRE + SCALE * F.col("_s.mu")).alias("mu"), (SCALE * phi).alias("rd"), F.col("_s.sigma").alias("sigma"))  # one row
