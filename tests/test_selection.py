"""Quantiles by selection against numpy, with groups of every kind."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from seriesloom.operators import selection
from seriesloom.operators.selection import exact_quantiles


def rows():
    r = random.Random(2)
    out = [("even", i % 2 * 1.0, float(i)) for i in range(2000)]
    out += [("skewed", math.exp(r.gauss(0, 40)), r.choice([1.0, 2.0, 1e300])) for _ in range(1501)]
    out += [("same", 7.0, -1e307 if i < 900 else 1e307) for i in range(1800)]
    out += [("halves", 1.0 if i < 600 else 5.0, r.random()) for i in range(1200)]
    out += [("few", r.random(), None) for _ in range(5)] + [(None, r.random(), float("nan") if i % 3 else 1.0) for i in range(1300)]
    out += [("none", None, None)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("q", "held"), [(0.5, 50), (0.9, 50), (0.0, 50), (0.25, 100_000)])
def test_groups(spark, monkeypatch, q, held):
    monkeypatch.setattr(selection, "HELD", held)
    monkeypatch.setattr(selection, "PARTS", 8)
    df = spark.createDataFrame(rows(), "g string, `a.b` double, y double").repartition(4)
    got = {r[0]: (r[1], r[2]) for r in exact_quantiles(df, ["a.b", "y"], ["g"], q).collect()}
    want = {}
    for g in {r[0] for r in rows()}:
        both = []
        for i in (1, 2):
            x = [r[i] for r in rows() if r[0] == g and r[i] is not None and not math.isnan(r[i])]
            both.append(float(np.percentile(x, q * 100)) if x else None)
        want[g] = tuple(both)
    assert got.keys() == want.keys()
    for g in want:
        for a, b in zip(got[g], want[g], strict=True):
            assert a is b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-300), (g, a, b)


def test_all_rows_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(selection, "HELD", 10)
    df = spark.range(1001).selectExpr("cast(id * id as double) as x")
    assert [tuple(r) for r in exact_quantiles(df, ["x"]).collect()] == [(250_000.0,)]
    assert [tuple(r) for r in exact_quantiles(df.limit(0), ["x"]).collect()] in ([(None,)], [])
