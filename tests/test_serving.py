"""The serving chain's tables and joins with ordered probes."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from seriesloom.operators import relations, serving, training


def candidates(spark):
    day = dt.date
    rows = [
        (1, day(2024, 1, 1), "home", "x", "r", "a", "b", 0.6, 2.0), (1, day(2024, 1, 1), "away", "x", "r", "a", "b", 0.1, 2.0), (2, day(2024, 1, 1), "home", None, None, "c", "d", 0.9, 1.0),
        (3, day(2024, 1, 2), "away", "x", "r", "e", "f", 0.5, 3.0), (4, day(2024, 1, 9), "home", "y", "r", "a", "b", None, 2.0), (5, day(2024, 1, 9), "home", "y", "r", "g", "h", 0.7, 2.0),
    ]
    return spark.createDataFrame(rows, "match_id long, day date, market string, league string, round string, home string, away string, p double, odds double")


def test_book(spark, tmp_path):
    bets = serving.recommendations(candidates(spark), 0.05)
    assert sorted((r.match_id, r.market, r.place) for r in bets.collect()) == [(1, "home", 1), (3, "away", 1), (5, "home", 1)]
    book = serving.Book(spark, str(tmp_path))
    book.save(bets)
    book.save(bets)  # once more changes nothing
    assert book.open_bets().count() == 3
    results = spark.createDataFrame([(1, "H", 1.9), (3, "H", None), (5, None, 2.0), (9, "H", 2.0)], "match_id long, result string, closing double")
    book.settle(results, {"home": "H", "away": "A"})
    first = {r.match_id: (r.hit, r.staked, r.pnl, r.clv) for r in book.settled().collect()}
    assert first == {1: (True, 30.0, 30.0, round(0.6 - 1 / 1.9, 6)), 3: (False, 30.0, -30.0, None)}
    book.settle(results.withColumn("result", F.lit("A")), {"home": "H"})  # settled bets stay as they were; the last is lost
    assert {r.match_id: r.pnl for r in book.settled().collect()} == {1: 30.0, 3: -30.0, 5: -30.0} and book.open_bets().count() == 0
    weeks = [tuple(r) for r in book.weekly().orderBy("week").select("bets", "wins", "losses", "pnl", "bankroll_start", "bankroll_end", "best", "worst", "by_market").collect()]
    assert weeks == [(2, 1, 1, 0.0, 1000.0, 1000.0, "1:home 3:away", "3:away 1:home", "away=1/-30.00 home=1/30.00"), (1, 0, 1, -30.0, 1000.0, 970.0, "5:home", "5:home", "home=1/-30.00")]


def test_mean_closing_values_at_ties(spark, tmp_path):
    """Means that lie between two rounded values fall alike in whatever order the rows come: as a loop from the worst bet on tells."""
    r = random.Random(5)
    rows, want = [], {}
    for week in range(300):
        values = [r.randrange(400_000) for _ in range(16)]
        values[-1] += (8 - sum(values)) % 16  # the mean ends in a half
        pnl = r.sample(range(100), 16)
        day = dt.date(2001, 1, 1) + dt.timedelta(weeks=week)
        total = 0.0
        for i in sorted(range(16), key=lambda i: pnl[i]):  # noqa: B023
            total += values[i] / 1e6
        want[day] = total / 16
        rows += [(day, i, "home", "x", True, 10.0, float(pnl[i]), v / 1e6) for i, v in enumerate(values)]
    book = serving.Book(spark, str(tmp_path))
    settled = spark.createDataFrame(rows, "day date, match_id int, market string, league string, hit boolean, staked double, pnl double, clv double")
    for order in (settled, settled.orderBy(F.desc("match_id"))):
        book.settled = lambda df=order: df
        assert {x.week: x.clv for x in book.weekly().collect()} == want


def test_running_totals(spark):
    r = random.Random(3)
    schema = "i int, day date, hit boolean, pnl double, staked double, clv double"
    for n, p in ((0, 0.5), (1, 0.0), (80, 0.5), (60, 1.0), (90, 0.95)):
        rows = [(i, dt.date(2024, 1, 1 + r.randrange(9)), r.random() < p, 0.0, 10.0, r.choice([None, r.random()])) for i in range(n)]
        rows = [(i, d, h, r.uniform(0, 300) if h else -r.uniform(0, 300), x, c) for i, d, h, _, x, c in rows]
        t = serving.running_totals(spark.createDataFrame(rows, schema).repartition(3), ["i"], 500.0).first()
        bank = peak = 500.0
        fall, streak = 0.0, 0
        for _, _, hit, pnl, _, _ in sorted(rows, key=lambda x: (x[1], x[0])):
            bank += pnl
            peak = max(peak, bank)
            fall = max(fall, (peak - bank) / peak)
            streak = (max(streak, 0) + 1) if hit else (min(streak, 0) - 1)
        clv = [x[5] for x in rows if x[5] is not None]
        assert (t.bets, t.wins, t.losses, t.streak) == (n, sum(x[2] for x in rows), n - sum(x[2] for x in rows), streak)
        assert abs(t.bankroll - bank) < 0.006 and abs(t.max_drawdown - fall) < 1e-9 and abs(t.mean_clv - (sum(clv) / len(clv) if clv else 0)) < 1e-9


def test_probes_in_order(spark):
    d = lambda n: dt.date(2024, 1, n)
    left = spark.createDataFrame([(1, "a", d(10)), (2, "a", d(20)), (3, "b", d(10)), (4, "c", d(10)), (5, None, d(10))], "id int, k string, day date")
    right = spark.createDataFrame([("a", d(9), 1), ("a", d(11), 2), ("a", d(9), 3), ("a", d(22), 4), ("b", d(10), 5), ("b", d(9), 6), ("c", d(14), 7), (None, d(10), 8)], "k string, at date, x int")
    out = relations.probed_join(left, right, ["k"], "day", "at", 2, ["id"], ["x"])
    assert sorted((r.id, r.x) for r in out.collect()) == [(1, 3), (2, 4), (3, 5), (4, None), (5, None)]


def test_targets_of_missing_scores(spark):
    df = spark.createDataFrame([(2, 1), (0, 0), (None, 3), (1, None)], "home_goals int, away_goals int")
    out = training.with_targets(df)
    assert len(out.columns) == 14
    got = [(r.result_1x2, r.over_2_5, r.btts, r.home_goals_over_1_5, r.away_goals_over_0_5, r.home_or_draw, r.margin, r.total_goals) for r in out.collect()]
    assert got == [("H", 1, 1, 1, 1, 1, 1, 3), ("D", 0, 0, 0, 0, 1, 0, 0), (None, None, None, None, 1, None, None, None), (None, None, None, 0, None, None, None, None)]
