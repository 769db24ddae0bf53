"""Ratings against plain folds over all matches in order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from swissline.operators import ratings
from swissline.sources.matches import match_view

SF = "/root/testdata/sf0.001"
KIND = "match_id long, day long, team1 string, team2 string, winner string, tier string, score1 long, score2 long"


def uneven(n=180, teams=9, days=8, seed=4):
    """Unknown winners, teams against themselves, idle teams, unknown tiers, missing scores, one team in a third of all rows."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        day = rnd.randrange(days)
        a = "hot" if i % 3 == 0 else f"t{rnd.randrange(teams) if day % 7 else rnd.randrange(3)}"
        b = f"t{rnd.randrange(teams)}"
        winner = rnd.choice([a, a, b, b, None, "stranger"])
        rows.append((i, day * 2, a, b, winner, rnd.choice(["S", "A", "B", "C", "?", None]), rnd.choice([None, 0, 5, 16]), rnd.choice([0, 7, 16])))
    return rows


def plain_elo(rows):
    now, before = {}, {}
    for i, _, a, b, w, tier, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        x, y = now.get(a, 1500.0), now.get(b, 1500.0)
        before[i] = x, y
        if a != b and w in (a, b):
            move = ratings.TIER_K.get(tier, ratings.OTHER_K) * ((w == a) - 1 / (1 + 10 ** ((y - x) / 400)))
            now[a], now[b] = x + move, y - move
        else:
            now.setdefault(a, x), now.setdefault(b, y)
    return before, now


def period(mu, phi, sigma, games, tau=0.5):
    """A team's period by the published steps, with the published root search."""
    g = lambda p: 1 / math.sqrt(1 + 3 * p * p / math.pi**2)
    e = lambda m, p: 1 / (1 + math.exp(-g(p) * (mu - m)))
    v = 1 / sum(w * g(p) ** 2 * e(m, p) * (1 - e(m, p)) for m, p, _, w in games)
    gain = sum(w * g(p) * (s - e(m, p)) for m, p, s, w in games)
    delta, a = v * gain, math.log(sigma**2)
    f = lambda x: math.exp(x) * (delta**2 - phi**2 - v - math.exp(x)) / (2 * (phi**2 + v + math.exp(x)) ** 2) - (x - a) / tau**2
    lo, k = a, 1
    if delta**2 > phi**2 + v:
        hi = math.log(delta**2 - phi**2 - v)
    else:
        while f(a - k * tau) < 0:
            k += 1
        hi = a - k * tau
    fl, fh = f(lo), f(hi)
    while abs(hi - lo) > 1e-12:
        mid = lo + (lo - hi) * fl / (fh - fl)
        fm = f(mid)
        if fm * fh <= 0:
            lo, fl = hi, fh
        else:
            fl /= 2
        hi, fh = mid, fm
        if fm == 0:
            break
    sigma = math.exp(hi / 2)
    wide = math.sqrt(phi**2 + sigma**2)
    phi = 1 / math.sqrt(1 / wide**2 + 1 / v)
    return mu + phi * phi * gain, phi, sigma


def plain_glicko(rows, margin=None):
    scale, state, before = 173.7178, {}, {}
    fresh = (0.0, 350 / scale, 0.06)
    for day in sorted({r[1] for r in rows}):
        games = {}
        for i, d, a, b, w, _, s1, s2 in rows:
            if d != day:
                continue
            x, y = state.get(a, fresh), state.get(b, fresh)
            before[i] = 1500 + scale * x[0], scale * x[1], 1500 + scale * y[0], scale * y[1]
            if a == b or w not in (a, b):
                continue
            weight = 1.0
            if margin and s1 is not None and s2 is not None and s1 + s2 and s1 != s2:
                weight = margin[0] * math.log(1 + abs(s1 - s2)) * margin[1] / (margin[1] + margin[2] * scale * abs(x[0] - y[0]))
            games.setdefault(a, []).append((y[0], y[1], float(w == a), weight))
            games.setdefault(b, []).append((x[0], x[1], float(w == b), weight))
        new = {t: period(*state.get(t, fresh), g) for t, g in games.items()}
        for t, (m, p, s) in state.items():
            new.setdefault(t, (m, min(fresh[1], math.sqrt(p * p + s * s)), s))
        state = {t: (m, min(p, fresh[1]), s) for t, (m, p, s) in new.items()}
    return before, {t: (1500 + scale * m, scale * p, s) for t, (m, p, s) in state.items()}


def near(got, want, tolerance=1e-6):
    assert got.keys() == want.keys()
    assert all(abs(x - y) < tolerance for k in want for x, y in zip(got[k], want[k])), next((k, got[k], want[k]) for k in want if any(abs(x - y) >= tolerance for x, y in zip(got[k], want[k])))


@pytest.mark.parametrize("most", [200, 25])
def test_elo_is_the_fold(spark, most):
    rows = uneven()
    m = spark.createDataFrame(rows, KIND).repartition(5)
    before, now = plain_elo(rows)
    found = ratings.elo(m, most=most)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "InPandas" not in plan
    near({r.match_id: (r.elo1, r.elo2) for r in found.collect()}, before)
    near({r.team: (r.elo,) for r in ratings.final_elo(m, found).collect()}, {t: (x,) for t, x in now.items()})
    assert (len(ratings.stretches(m, most)) > 1) == (most == 25)


@pytest.mark.parametrize("margin", [None, (1.0, 2.2, 0.001)])
def test_glicko_is_the_fold(spark, margin):
    rows = uneven()
    m = spark.createDataFrame(rows, KIND).repartition(5)
    before, end = plain_glicko(rows, margin)
    near({r.match_id: (r.mu1, r.rd1, r.mu2, r.rd2) for r in ratings.glicko(m, margin=margin).collect()}, before, 1e-5)
    near({r.team: (r.mu, r.rd, r.sigma) for r in ratings.final_glicko(m, margin=margin).collect()}, end, 1e-5)


def test_unknown_winners_move_nothing(spark):
    rows = [(1, 1, "a", "b", None, "S", 1, 0), (2, 2, "a", "b", "a", "S", 1, 0), (3, 2, "c", "c", "c", "S", 1, 0), (4, 3, "a", "b", "b", "S", 1, 0)]
    m = spark.createDataFrame(rows, KIND)
    got = {r.match_id: r for r in ratings.glicko(m).collect()}
    assert (got[1].mu1, got[2].mu1, got[2].mu2, got[3].mu1) == (1500, 1500, 1500, 1500) and got[4].mu1 > 1500 > got[4].mu2
    elo = {r.match_id: r for r in ratings.elo(m).collect()}
    assert elo[2].elo1 == elo[3].elo1 == 1500 and elo[4].elo1 == 1516
    assert ratings.elo(m.limit(0)).isEmpty() and ratings.glicko(m.limit(0)).isEmpty() and ratings.final_glicko(m.limit(0)).isEmpty()


def one_period(spark, mu, phi, sigma, games, tau):
    i, d = ratings.contributions(F.col("mu"), F.col("other_mu"), F.col("other_phi"), F.col("score"), F.col("weight"))
    df = spark.createDataFrame([(mu, phi, sigma, *g) for g in games], "mu double, phi double, sigma double, other_mu double, other_phi double, score double, weight double")
    sums = df.groupBy("mu", "phi", "sigma").agg(F.sum(i).alias("i"), F.sum(d).alias("d"))
    r = ratings.advanced(sums, tau).first()
    return r.mu, r.phi, r.sigma


def test_glicko_published_example(spark):
    to = lambda r, d: ((r - 1500) / 173.7178, d / 173.7178)
    mu, phi, sigma = one_period(spark, *to(1500, 200), 0.06, [(*to(r, d), s, 1.0) for r, d, s in ((1400, 30, 1.0), (1550, 100, 0.0), (1700, 300, 0.0))], 0.5)
    assert abs(1500 + 173.7178 * mu - 1464.06) < 0.02 and abs(173.7178 * phi - 151.52) < 0.02 and abs(sigma - 0.05999) < 1e-5


def test_certain_games_after_an_infinite_volatility_only_widen(spark):
    """A game whose outcome is certain has no precision; with an infinite volatility before it both parts of the sum are zero."""
    assert one_period(spark, 2000.0, 2.0, math.inf, [(0.0, 0.2, 1.0, 1.0)], 0.5) == (2000.0, math.inf, math.inf)
    mu, phi, sigma = one_period(spark, 2000.0, 2.0, 0.5, [(0.0, 0.2, 1.0, 1.0)], 0.5)
    assert (mu, sigma) == (2000.0, 0.5) and abs(phi - math.sqrt(4.25)) < 1e-12
    widths = spark.range(2).select(ratings._widened(F.lit(0.3), F.lit(math.inf), F.col("id"), 2.0).alias("phi"))
    assert sorted(r.phi for r in widths.collect()) == [0.3, 2.0]


def test_large_upsets_raise_volatility_as_published(spark):
    """Both branches of the search for the volatility; games without weight."""
    for phi, tau, games in ((0.3, 0.5, [(3.0, 0.2, 1.0, 1.0)] * 6), (0.3, 1.2, [(3.0, 0.2, 1.0, 1.0)] * 3), (2.0, 0.5, [(0.0, 1.0, 1.0, 1.0)]), (0.5, 3.0, [(-1.0, 0.4, 0.0, 0.5)] * 4)):
        near({1: one_period(spark, 0.1, phi, 0.06, games, tau)}, {1: period(0.1, phi, 0.06, games, tau)}, 1e-8)
    near({1: one_period(spark, 0.1, 1.0, 0.06, [(0.0, 1.0, 1.0, 0.0)], 0.5)}, {1: (0.1, math.hypot(1.0, 0.06), 0.06)}, 1e-12)


def test_ratings_do_not_depend_on_partitions(spark):
    found = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        m = match_view(spark, SF).repartition(int(n))
        m = m.filter(F.col("day") < m.agg(F.min("day") + 6).first()[0])
        found.append([sorted(map(tuple, ratings.elo(m).collect())), sorted(tuple(round(x, 8) for x in r) for r in ratings.glicko(m).collect())])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_a_round_sends_k_once_and_no_old_rating_unless_asked(spark):
    m = spark.createDataFrame([(1, 5, 10, 20, 32.0, 1500.0, 1500.0, 1500.0, 1500.0), (2, 6, 20, 10, -32.0, 1500.0, 1500.0, 1500.0, 1500.0), (3, 6, 10, 30, None, 1500.0, 1500.0, 1500.0, 1500.0)], "match_id long, day long, team1 long, team2 long, k double, start1 double, start2 double, elo1 double, elo2 double")
    plain, last = ratings._round(m, False), ratings._round(m, True)
    assert plain.columns == m.columns and last.columns == [*m.columns, "change"]
    got = {r.match_id: r for r in last.collect()}
    assert (got[1].elo1, got[2].elo1, got[2].elo2, got[3].elo1, got[3].elo2) == (1500, 1484, 1516, 1532, 1500)
    assert (got[1].change, got[2].change, got[3].change) == (0, 16, 32) and (got[1].k, got[2].k, got[3].k) == (32, -32, None)
