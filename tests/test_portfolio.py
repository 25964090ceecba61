"""Limits of portfolios and standings against plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import portfolio, stateful


def plain_limits(bets, cap):
    """bets: (batch, id, home, away, stake) in order."""
    stake, bound, teams = {b[1]: b[4] for b in bets}, {}, {}
    for batch, i, h, a, _ in bets:
        for t in dict.fromkeys((h, a)):
            if t is not None:
                teams.setdefault((batch, t), []).append(i)
    for mine in teams.values():
        total = sum(stake[i] for i in mine)
        if total > cap:
            for i in mine:
                stake[i] *= cap / total
                bound[i] = "team"
    return stake, bound


def run_limits(spark, bets, cap):
    df = spark.createDataFrame(bets, "batch long, id long, home long, away long, stake double").withColumn("bound", F.lit(None).cast("string"))
    out = portfolio.team_limits(df.repartition(4), ["batch"], ["id"], "home", "away", cap).collect()
    return {r.id: r.stake for r in out}, {r.id: r.bound for r in out if r.bound}


@pytest.mark.parametrize("few", [2, 100_000])
def test_team_limits_equal_a_plain_loop(spark, monkeypatch, few):
    monkeypatch.setattr(portfolio, "FEW", few)
    r = random.Random(1)
    pick = lambda n: None if r.random() < 0.03 else r.randrange(n)
    bets = [(i // 60 if i < 120 else None, i, pick(25), pick(25), r.random() / 10) for i in range(170)]
    stake, bound = plain_limits(bets, 0.3)
    got, marked = run_limits(spark, bets, 0.3)
    assert got.keys() == stake.keys() and all(math.isclose(got[i], stake[i], abs_tol=1e-12) for i in stake)
    assert marked == bound and len(bound) > 20


def test_a_hub_and_a_chain(spark, monkeypatch):
    monkeypatch.setattr(portfolio, "FEW", 0)
    bets = [(0, i, 0, 1 + i, 0.01) for i in range(2000)] + [(1, 5000 + i, i, i + 1, 1.0) for i in range(4)]
    stake, bound = plain_limits(bets, 0.5)
    got, marked = run_limits(spark, bets, 0.5)
    assert all(math.isclose(got[i], stake[i], abs_tol=1e-12) for i in stake) and marked == bound


def test_a_large_batch(spark):
    """One batch of 200,000 bets, over many tasks."""
    n = 200_000
    df = spark.range(0, n, 1, 8).select(F.lit(1).alias("batch"), "id", F.pmod(F.xxhash64("id"), F.lit(30_000)).alias("home"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30_000)).alias("away"))
    df = df.withColumns({"stake": F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 10_000 + 0.001, "bound": F.lit(None).cast("string")})
    bets = [tuple(r) for r in df.select("batch", "id", "home", "away", "stake").orderBy("id").collect()]
    stake, bound = plain_limits(bets, 1.0)
    out = portfolio.team_limits(df, ["batch"], ["id"], "home", "away", 1.0).collect()
    assert len(out) == n and all(math.isclose(r.stake, stake[r.id], abs_tol=1e-12) for r in out)
    assert {r.id for r in out if r.bound} == bound.keys() and len(bound) > 5000


def test_chain_of_limits(spark):
    rows = [(1, 1, 0.6, 2.0, "a", "b", "r", "x"), (1, 2, 0.6, 2.0, "a", "c", "r", "x"), (1, 3, 0.3, 2.0, "d", "e", None, None), (1, 4, 0.52, 2.0, "f", "g", None, None), (2, 5, 0.9, 1.0, "a", "b", "r", "x")]
    df = spark.createDataFrame(rows, "day int, id int, p double, odds double, home string, away string, round string, league string")
    got = portfolio.portfolio_stakes(df, ["day"], ["id"], "p", "odds", "home", "away", "round", "league", per_round=0.055, per_league=0.052, per_team=0.05, hook=lambda f: f * 0.9)
    got = {r.id: (round(r.raw_kelly, 9), round(r.adjusted_kelly, 9), round(r.stake, 9), r.bound) for r in got.collect()}
    assert got[1] == got[2] == (0.2, 0.05, 0.025, "team")
    assert got[3] == (0.0, 0.0, 0.0, None) and got[4] == (0.04, 0.01, 0.009, None) and got[5] == (0.0, 0.0, 0.0, None)


def plain_standings(rows):
    seasons, out = {}, []
    for i, s, _, h, a, x, y in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        table = seasons.setdefault(s, {})
        for t in (h, a):
            table.setdefault(t, [0, 0, 0, len(table), 0])
        order = sorted(table, key=lambda t: (-table[t][0], -table[t][1], -table[t][2], table[t][3]))
        row = [i, len(order)]
        for t in (h, a):
            p, d, _, _, c = table[t]
            gaps = [p - table[order[3]][0], p - table[order[-4]][0]] if len(order) >= 4 else [0, 0]
            row += [order.index(t) + 1, p, d, c, *gaps]
        out.append(tuple(row))
        if x is not None and y is not None:
            for t, f, g in ((h, x, y), (a, y, x)):
                v = table[t]
                v[0] += 3 if f > g else 1 if f == g else 0
                v[1] += f - g
                v[2] += f
                v[4] += 1
    return sorted(out)


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_standings_equal_a_plain_table(spark, monkeypatch, block):
    monkeypatch.setattr(stateful, "BLOCK", block)
    r = random.Random(4)
    rows = [(i, r.choice([1, 1, 2, 3]), r.randrange(40), *r.sample(range(11), 2), *(r.choice([None, 0, 1, 2, 3]) for _ in range(2))) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, season int, day int, home int, away int, home_score int, away_score int").repartition(3)
    got = sorted(tuple(x) for x in stateful.standings(df, "season", ["day", "id"]).collect())
    assert got == plain_standings(rows)
    assert stateful.standings(df.limit(0), "season", ["day", "id"]).count() == 0
