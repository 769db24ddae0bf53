import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swissline.functions import keys
from swissline.operators import form, ratings, swiss
from swissline.sources import pages
from swissline.plans.catalogue import rounded
from swissline.sources.matches import long_form, match_view

SF = "/root/testdata/sf0.001"


def test_future_does_not_leak(spark):
    m = match_view(spark, SF).cache()
    cut = m.selectExpr("percentile(day, 0.5)").first()[0]
    past = m.filter(F.col("day") <= cut)
    for f in (lambda x: form.recent_winrate(long_form(x), 5), lambda x: form.streak(long_form(x)), lambda x: form.decayed_winrate(long_form(x)), lambda x: rounded(ratings.elo(x)), lambda x: rounded(ratings.glicko(x)), form.h2h):
        whole = f(m).join(past.select("match_id"), "match_id", "left_semi")
        assert f(past).exceptAll(whole).isEmpty()


def test_elo_is_zero_sum(spark):
    m = match_view(spark, SF)
    last = ratings.elo(m).join(m.select("match_id", "team1", "team2"), "match_id")
    assert last.count() == m.count() and last.filter("elo1 is null").isEmpty()


def test_bradley_terry_is_stationary(spark):
    m = match_view(spark, SF)
    theta = {r.team: r.theta for r in ratings.bradley_terry(m, ridge=1.0).collect()}
    assert abs(sum(theta.values())) < 1e-6
    won = {}
    for r in m.collect():
        for t, o in ((r.team1, r.team2), (r.team2, r.team1)):
            e = 1 / (1 + math.exp(theta[o] - theta[t]))
            won[t] = won.get(t, 0.0) + (r.winner == t) - e
    pi = np.array([math.exp(theta[t]) for t in won])
    assert np.abs(np.array(list(won.values())) + 1 - pi).max() < 0.6  # the ridge pulls to one


def test_brackets_end_with_eight_and_no_rematch():
    rng = np.random.default_rng(5)
    p = np.clip(rng.random((16, 16)), 0.1, 0.9)
    for _ in range(60):
        out = swiss.bracket(p, p, lambda r, i: rng.random())
        assert sum(w == 3 for w, _ in out) == 8 and sum(n == 3 for _, n in out) == 8


def test_keys(spark):
    df = spark.createDataFrame([(" Alpha B ", "beta", "a|De_Dust2; ;mirage", "12.7"), (None, "", "", "x")], "a string, b string, c string, n string")
    got = df.select(keys.pair_key(F.col("a"), F.col("b")).alias("k"), keys.pair_key(F.col("b"), F.col("a")).alias("k2"), keys.split_list(F.col("c")).alias("l"), keys.number(F.col("n"), 0.5).alias("n")).collect()
    assert got[0].k == got[0].k2 == "alpha b__beta" and got[0].l == ["a", "dust2", "mirage"] and got[0].n == 12.7 and got[1].n == 0.5


def test_version_log_and_text(spark):
    lines = spark.createDataFrame([("2024-01-02,v1",), ("# note",), ("2024-02-03 v2 # x",), ("bad",)], "value string")
    assert [(str(r.date), r.tag) for r in pages.version_log(lines).orderBy("date").collect()] == [("2024-01-02", "v1"), ("2024-02-03", "v2")]
    assert spark.range(1).select(pages.strip_tags(F.lit("<p>A &amp; <b>B</b>\n</p>")).alias("x")).first().x == "A & B"


def test_csv_feed_and_sinks(spark, tmp_path):
    from swissline.sources import feeds

    (tmp_path / "t.csv").write_text("team,rank,rating\nA,12.7,1.5\nB,,x\n")
    got = {r.team: (r["rank"], r.rating, r._corrupt) for r in feeds.read_csv(spark, str(tmp_path / "t.csv"), ["team", "rank", "rating"]).collect()}
    assert got == {"A": (12, 1.5, 0), "B": (None, None, 1)}
    seeded = feeds.with_seeds(spark.createDataFrame([("A",), ("B",)], "team string"), "team").collect()
    assert [(r.team, r.seed, r.strength) for r in seeded] == [("A", 1, 1.0), ("B", 2, 0.5)]
    feeds.write_csv(spark.createDataFrame([(1, ["a", "b"])], "i int, l array<string>"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().l == "a|b"


def test_platt_undoes_a_distortion(spark):
    from swissline.operators import model

    rng = np.random.default_rng(2)
    z = rng.normal(0, 1.5, 6000)
    y = (rng.random(6000) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame([(float(1 / (1 + np.exp(-2 * x - 0.5))), int(k)) for x, k in zip(z, y)], "p double, label int")
    a, b = model.platt(df)
    assert abs(a - 0.5) < 0.07 and abs(b + 0.25) < 0.12 and abs(model.temperature(df) - 0.5) < 0.1


def test_stream_drops_repeats(spark, tmp_path):
    from swissline.streaming import ingest

    rows = spark.createDataFrame([("2024-01-01 00:00:00", "u1", 1, 2, "m", 1, 1), ("2024-01-01 01:00:00", "u1", 1, 2, "m", 1, 1), ("2024-01-02 00:00:00", None, 2, 1, "m", 1, 2)], "t string, url string, team1 int, team2 int, map string, best_of int, day int")
    rows.withColumn("ts", F.to_timestamp("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    ingest.upsert_into(ingest.first_seen(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_swap_search_finds_the_best_ticket_of_one_swap_each(spark):
    """Against brute force over the same samples: no single swap is better at the end, and the figure is that of the ticket."""
    from swissline.operators import tickets

    strengths = [1 - i / 16 for i in range(16)]
    samples = swiss.simulate(spark, strengths, 400)
    data = {}
    for r in samples.collect():
        data.setdefault(r.sim, {})[r.seed_no] = "3-0" if (r.wins, r.losses) == (3, 0) else "0-3" if (r.wins, r.losses) == (0, 3) else "advance" if r.wins == 3 else ""
    score = lambda t: sum(sum(s[seed] == k for k, seed in t) >= 5 for s in data.values()) / len(data)
    start = [("3-0", 14), ("3-0", 1), ("0-3", 15), ("0-3", 0), *(("advance", i) for i in (2, 3, 4, 5, 12, 13))]
    pool = [(k, i) for k in ("3-0", "advance") for i in range(16)] + [("0-3", i) for i in reversed(range(16))]
    ticket, p = tickets.swap_search(samples, start, pool)
    assert abs(p - score(ticket)) < 1e-9 and p > score(start) and len({s for _, s in ticket}) == 10
    taken = {s for _, s in ticket}
    for i, (k, _) in enumerate(ticket):
        for c, s in pool:
            if c == k and s not in taken:
                assert score([*ticket[:i], (c, s), *ticket[i + 1 :]]) <= p + 1e-9
    assert tickets.swap_search(samples.filter("sim < 0"), start, pool)[1] == 0


def test_scores_and_sheet_without_known_features(spark):
    from swissline.operators import tickets

    teams = spark.range(4).selectExpr("id as seed_no", "0.5D as p_30", "cast(null as double) as p_03", "0.25D as p_advance")
    got = {(r.category, r.seed_no): r.score for r in tickets.risk_scores(teams).collect()}
    assert got["3-0", 0] == 0.5 and got["0-3", 1] == 0 and got["advance", 2] == 0.25
    sheet = {r.category: r for r in tickets.answer_sheet(spark.createDataFrame([("3-0", 1, 0.1), ("3-0", 2, None), ("0-3", 1, 0.01)], "category string, seed_no long, margin double")).collect()}
    assert sheet["3-0"].warnings == "repeated,unknown_margin" and sheet["0-3"].warnings == "slots,repeated,narrow" and sheet["advance"].warnings == "slots" and sheet["advance"].picks == 0


def test_ranking_and_player_pages(spark):
    ranking = """<div class="ranked-team standard-box"><span class="position">#1</span><a href="/team/1/alpha"><span class="name">Alpha</span></a><span class="points">1,927 points</span><span class="country">Europe</span></div>
      <div class="ranked-team"><a href="/team/2/bravo">Bravo  #7 now</a></div><div class="ranked-team"><a href="/team/1/alpha">ALPHA</a></div><div class="ranked-team">no team</div>"""
    players = """<table><tr class="player-row"><td class="player"><a href="/player/11/a">a_w</a></td><td class="team">Alpha</td><td class="rating">1.34</td><td class="opening-success">61%</td><td class="clutch">0.4</td><td class="role">stand-in</td></tr>
      <tr><td><a href="/player/12/b">b</a></td></tr><tr><td class="team">Alpha</td></tr></table>"""
    df = spark.createDataFrame([(1, ranking), (2, players), (3, ""), (4, None)], "page_id long, html string")
    assert [(r.team, r.rank, r.points, r.region, r.link) for r in pages.ranking_rows(df).orderBy("place").collect()] == [("Alpha", 1, 1927, "Europe", "/team/1/alpha"), ("Bravo", 7, 0, "", "/team/2/bravo")]
    (r,) = pages.player_rows(df, "2026-01-01").collect()
    assert (r.player, r.team, r.date, r.rating, r.kd, r.opening_success, r.clutch_winrate, r.is_substitute) == ("a_w", "Alpha", "2026-01-01", 1.34, 1.0, 0.61, 0.4, 1)
    assert pages.match_cards(df).count() == 0


def test_payloads_of_other_shapes(spark):
    from swissline.sources import results_api

    good = '{"data": {"list": [{"mc_info": {"id": 5, "t1_info": {"name": "A"}, "t2_info": {"team_name": "B"}, "format": "x"}, "state": {"t1_score": "2", "t2_score": 1}}, {"mc_info": {"id": 6, "t1_info": {"name": "A"}}}]}}'
    rows = results_api.parsed(spark.createDataFrame([(good,), ("not json",), ("[]",), (None,), ('{"data": {}}',)], "payload string"))
    (r,) = results_api.matches(rows).collect()
    assert (r.match_id, r.winner, r.best_of, r.n_maps, r.date, r.status) == ("5", "A", None, 0, None, None)
    assert results_api.maps(rows).count() == 0 and results_api.page_token(rows).count() == 0


def test_rolling_strengths_are_those_of_the_days_before(spark):
    m = match_view(spark, SF).cache()
    got = {r.match_id: r for r in ratings.rolling_bradley_terry(m).collect()}
    days = sorted({r.day for r in m.select("day").distinct().collect()})
    assert len(got) == m.count()
    for day in (days[0], days[len(days) // 2], days[-1]):
        theta = {r.team: r.theta for r in ratings.bradley_terry(m.filter(F.col("day") < day)).collect()}
        for r in m.filter(F.col("day") == day).collect():
            assert abs(got[r.match_id].theta1 - theta.get(r.team1, 0.0)) < 1e-9 and abs(got[r.match_id].theta2 - theta.get(r.team2, 0.0)) < 1e-9


def test_final_elo_and_opponent_weights(spark):
    m = match_view(spark, SF).cache()
    before = {r.match_id: r for r in ratings.elo(m).collect()}
    now, history, want = {}, {}, {}
    for r in sorted(m.collect(), key=lambda r: (r.day, r.match_id)):
        a, b = before[r.match_id].elo1, before[r.match_id].elo2
        assert abs(now.get(r.team1, 1500.0) - a) < 1e-9 and abs(now.get(r.team2, 1500.0) - b) < 1e-9
        for side, (t, opp, won) in enumerate(((r.team1, b, r.winner == r.team1), (r.team2, a, r.winner == r.team2)), 1):
            past = history.setdefault(t, [])[-10:]
            want[r.match_id, side] = sum(w * x for x, w in past) / sum(w for _, w in past) if past else 0.5
        for t, opp, won in ((r.team1, b, r.winner == r.team1), (r.team2, a, r.winner == r.team2)):
            history[t].append((float(won), 2 / (1 + math.exp(-(opp - 1500) / 400))))
        move = ratings.TIER_K[r.tier] * ((r.winner == r.team1) - 1 / (1 + 10 ** ((b - a) / 400)))
        now[r.team1], now[r.team2] = a + move, b - move
    assert all(abs(r.elo - now[r.team]) < 1e-9 for r in ratings.final_elo(m, ratings.elo(m)).collect())
    assert all(abs(r.winrate - want[r.match_id, r.side]) < 1e-9 for r in form.opponent_winrate(long_form(m), ratings.elo(m)).collect())


def test_candidate_maps_without_history_or_with_all_banned(spark):
    from swissline.operators import market

    profiles = spark.createDataFrame([(1, m, 0.5, 0, 1) for m in "ab"], "team long, map string, winrate double, preferred int, banned int")
    fixtures = spark.createDataFrame([(1, 1, 2), (2, 3, 4)], "match_id long, team1 long, team2 long")
    got = sorted((r.match_id, r.place, r.map, round(r.weight, 6)) for r in market.candidate_maps(profiles, fixtures, ["a", "b"]).collect())
    assert got == [(2, 1, "a", 0.5), (2, 2, "b", 0.5)]


def test_feature_selection_against_numpy(spark):
    from swissline.operators import splits

    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(300, 5))
    x[:, 1] = x[:, 0] + rnd.normal(size=300) * 0.1
    x[:, 3] *= 0.01
    label = (x[:, 2] + 0.3 * x[:, 0] > 0).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(y)) for r, y in zip(x, label)], "a double, b double, c double, d double, e double, label double")
    got = [(r.feature, r.importance) for r in splits.selected_features(df, list("abcde"), "label", 3, ("e",)).orderBy("place").collect()]
    r = {c: abs(np.corrcoef(x[:, i], label)[0, 1]) for i, c in enumerate("abcde")}
    assert [c for c, _ in got] == ["c", "a", "e"] and all(abs(s - r[c]) < 1e-9 for c, s in got)
    assert splits.selected_features(df.limit(0), list("ab"), "label").count() == 0


def test_calibrations_recover_their_own_curve(spark):
    from swissline.operators import model

    rnd = np.random.default_rng(7)
    p = rnd.uniform(0.02, 0.98, 6000)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    label = (rnd.uniform(size=6000) < sigmoid(2.0 * np.log(p) - 0.5 * np.log(1 - p) + 0.7)).astype(int)
    df = spark.createDataFrame([(i // 20, float(a), int(y)) for i, (a, y) in enumerate(zip(p, label))], "day long, p double, label int").cache()
    a, b, c = model.beta(df, ridge=0.0)
    assert abs(a - 2.0) < 0.25 and abs(b - 0.5) < 0.2 and abs(c - 0.7) < 0.3
    losses = {r.method: r.loss for r in model.calibration_losses(df).collect()}
    assert min(losses, key=losses.get) == "beta" and losses["platt"] < losses["raw"]
    flat = df.withColumn("label", (F.col("p") < 0.5).cast("int"))
    assert min(model.beta(flat)[:2]) >= 0
    assert model.platt(df.limit(0)) == (1.0, 0.0) and model.calibration_losses(df.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", ["4", "8", "200"])
@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_places_in_a_total_order_with_carried_columns(spark, sf, partitions):
    from swissline.operators import splits
    from swissline.sources.matches import match_view

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        m = match_view(spark, f"/root/testdata/sf{sf}")
        wide = splits.ranked(m.select("match_id", "day", "v1", "v2", "tier"), "day", "match_id").select("place", "match_id", "v1", "v2", "tier").toPandas()
        plain = m.select("match_id", "day", "v1", "v2", "tier").toPandas().sort_values(["day", "match_id"]).reset_index(drop=True)
        wide = wide.sort_values("place").reset_index(drop=True)
        assert (wide.place == range(1, len(plain) + 1)).all() and (wide.match_id == plain.match_id).all() and (wide.v1 == plain.v1).all()
        parts = splits.ratio_split(m, 0.8, 0.1, "day", "match_id").groupBy("part").count().collect()
        n = len(plain)
        assert {r[0]: r[1] for r in parts} == {"train": int(n * 0.8), "validation": int(n * 0.1), "test": n - int(n * 0.8) - int(n * 0.1)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_strengths_by_map_are_drawn_to_the_whole(spark):
    m = match_view(spark, SF)
    whole = {r.team: r.theta for r in ratings.bradley_terry(m).collect()}
    near = ratings.bradley_terry_by_map(m, ridge=1e6, pool=("unplayed",)).collect()
    for name in {r["map"] for r in near}:
        own = {r.team: r.theta for r in near if r["map"] == name}
        mean = sum(whole[t] for t in own) / len(own)
        assert all(abs(own[t] - (whole[t] - mean)) < 1e-3 for t in own)
    assert {r.team for r in near if r["map"] == "unplayed"} == set(whole)


def test_fits_keep_places_and_games_alone(monkeypatch):
    # batches of a group are read one after another, and places don't depend on how they are cut
    rnd = np.random.default_rng(3)
    x = rnd.integers(-50, 50, (2, 1000)) * 10**12
    batches = [pa.RecordBatch.from_arrays([pa.array(a[k : k + 7]) for a in x], ["lo", "hi"]) for k in range(0, 1000, 7)]
    monkeypatch.setattr(ratings, "CHUNK", 100)
    places, seen = ratings.Places(), []
    for lo, hi in ratings._chunks(iter(batches), ["lo", "hi"]):
        assert len(lo) <= 107
        seen.append((places.of(lo), places.of(hi)))
    assert all(a.dtype == np.int32 for pair in seen for a in pair)
    assert (places.names[np.concatenate([s[0] for s in seen])] == x[0]).all() and (places.names[np.concatenate([s[1] for s in seen])] == x[1]).all()
    assert len(set(places.names.tolist())) == len(places.names) == len(np.unique(x))


def test_figures_of_a_card_are_read_once(spark):
    plan = pages.match_cards(spark.createDataFrame([(1, "<html></html>")], "page_id long, html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("score-won") == 1 and plan.count("event-name") == 1 and plan.count("team1\\b") == 1


def test_tasks_of_ballots_grow_with_them(spark, monkeypatch):
    from swissline.operators import fusion

    monkeypatch.setattr(fusion, "TASK_ROWS", 10)
    rows = [(g, b, t, "3-0" if (t + b) % 3 else "0-3") for g in range(4) for b in range(10) for t in range(10)]
    ballots = spark.createDataFrame(rows + rows[:7], "g long, ballot long, team long, category string")
    shares = fusion.vote_shares(ballots, "g")
    assert "hashpartitioning(g#" in (plan := shares._jdf.queryExecution().executedPlan().toString()) and ", 41), REPARTITION_BY_NUM" in plan
    want = {(g, t, c): sum(r[0] == g and r[2] == t and r[3] in of for r in rows) / 10 for g in range(4) for t in range(10) for c, of in (("3-0", ["3-0"]), ("advance", ["3-0"]), ("0-3", ["0-3"]))}
    assert {(r.g, r.team, r.category): r.experts for r in shares.collect()} == {k: v for k, v in want.items() if v}
