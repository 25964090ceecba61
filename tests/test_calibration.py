"""Calibration of many groups against plain fits."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.operators import calibration, learning, metrics


def rows():
    r = random.Random(8)
    out = []
    for i in range(3000):
        raw = [r.random() ** 2 + 0.02 for _ in range(3)]
        p = [x / sum(raw) for x in raw]
        sharp = [x**1.7 for x in p]
        y = r.choices(range(3), weights=p)[0]
        out.append((i, i % 3, [x / sum(sharp) for x in sharp], y))
    return out


def newton(x, t):
    a, b = 1.0, 0.0
    for _ in range(100):
        s = 1 / (1 + np.exp(-(a * x + b)))
        w = s * (1 - s)
        h = np.array([[np.sum(w * x * x), np.sum(w * x)], [np.sum(w * x), np.sum(w)]])
        d = np.linalg.solve(h, np.array([np.sum((s - t) * x), np.sum(s - t)]))
        a, b = a - d[0], b - d[1]
    return a, b


def test_platt_of_all_groups(spark):
    df = spark.createDataFrame(rows(), "i int, g int, p array<double>, y int")
    found = calibration.fit_platt(df, "p", "y", "g")
    for g in range(3):
        for k in range(3):
            mine = [r for r in rows() if r[1] == g]
            p = np.clip(np.array([r[2][k] for r in mine]), 1e-6, 1 - 1e-6)
            want = newton(np.clip(np.log(p / (1 - p)), -15, 15), np.array([float(r[3] == k) for r in mine]))
            assert np.allclose(found[g][2 * k : 2 * k + 2], want, atol=1e-6)
    alone = learning.Platt().fit(df.where("g = 1"), "p", "y")
    assert np.allclose(np.array(alone.curves).reshape(-1), found[1], atol=1e-9)
    out = calibration.calibrated(df, "p", "g", "platt", found)
    assert out.count() == 3000 and out.where("abs(p[0] + p[1] + p[2] - 1) > 1e-9").count() == 0


def test_temperature_of_all_groups(spark):
    df = spark.createDataFrame(rows(), "i int, g int, p array<double>, y int")
    found = calibration.fit_temperature(df, "p", "y", "g")
    for g in range(3):
        mine = [r for r in rows() if r[1] == g]
        z = np.log(np.maximum(np.array([r[2] for r in mine]), 1e-6))
        y = np.array([r[3] for r in mine])
        loss = lambda t: -np.mean(np.log(np.exp(z[np.arange(len(y)), y] / t) / np.exp(z / t).sum(axis=1)))  # noqa: B023, E731
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 20_000))
        best = grid[np.argmin([loss(t) for t in grid[::40]]) * 40]
        assert abs(found[g][0] - best) < 0.02 * best and loss(found[g][0]) <= loss(best) + 1e-5
        assert abs(found[g][0] - learning.Temperature().fit(df.where(F.col("g") == g), "p", "y").t) < 1e-9


def test_separable_and_empty_groups(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1], 0), (0, [0.2, 0.8], 1), (1, [0.5, 0.5], 0)], "g int, p array<double>, y int")
    found = calibration.fit_platt(df, "p", "y", "g")
    assert all(np.isfinite(found[0])) and all(np.isfinite(found[1]))
    assert calibration.fit_platt(df.limit(0), "p", "y", "g") == {} and calibration.fit_temperature(df.limit(0), "p", "y", "g") == {}


def test_rows_without_a_class_or_with_nan(spark):
    """They tell nothing of a curve; a group of them alone gets none."""
    df = spark.createDataFrame(rows(), "i int, g int, p array<double>, y int").where("g = 1")
    more = spark.createDataFrame([(-1, 1, [0.2, 0.3, 0.5], None), (-2, 5, [0.2, 0.3, 0.5], None)], df.schema)
    got, want = calibration.fit_platt(df.unionByName(more), "p", "y", "g"), calibration.fit_platt(df, "p", "y", "g")
    assert list(got) == [1] and np.allclose(got[1], want[1], atol=1e-7)
    nan = spark.createDataFrame([(-3, 1, [float("nan"), 0.5, 0.5], 1), (-4, 1, [0.5, 0.5], 2)], df.schema)
    assert calibration.fit_temperature(df.unionByName(more).unionByName(nan), "p", "y", "g") == calibration.fit_temperature(df, "p", "y", "g")


def test_jobs_don_t_grow_with_folds(spark):
    df = spark.createDataFrame(rows(), "i int, g int, p array<double>, y int")
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for folds in (2, 6):
        spark.sparkContext.setJobGroup(f"folds {folds}", "")
        best, means = learning.select_calibration(df, "p", "y", ["i"], ("none", "platt", "temperature"), folds)
        counts.append(len(tracker.getJobIdsForGroup(f"folds {folds}")))
        assert best in ("platt", "temperature") and means[best] < means["none"]
    spark.sparkContext.setJobGroup("", "")
    assert counts[1] <= counts[0] + 30, counts


def test_rolling_error_equals_plain_loops(spark):
    """Each row's last rows alone tell its error: no frame is summed anew, and NaN or a p far off leaves with its row."""
    r, window = random.Random(8), 7
    rows = [(g, i, r.choice([None, 0.0, 1.0, 1.7, -0.3] + [r.random()] * 9), r.choice([True, False, None] if i % 5 == 0 else [True, False])) for g in range(4) for i in range(120)]
    rows[30] = (0, 30, float("nan"), True)
    rows[60] = (0, 60, -1e9, True)
    df = spark.createDataFrame(rows, "g int, i int, p double, y boolean")
    out = df.select("g", "i", metrics.rolling_ece(F.col("p"), F.col("y"), W.partitionBy("g").orderBy("i"), window).alias("e"))
    assert "specifiedwindowframe(RowFrame, -" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(x.g, x.i): x.e for x in out.collect()}
    for k, (g, i, _, _) in enumerate(rows):
        last = rows[max(k - window + 1, 120 * g) : k + 1]
        if len(last) < window or any(p is None for _, _, p, _ in last):
            assert got[g, i] is None
            continue
        sums = [0.0] * 10
        for _, _, p, y in last:
            b = 0 if math.isnan(p) else max(math.ceil(p * 10) - 1, 0)
            if b < 10 and y is not None:
                sums[b] += y - p
        want = sum(map(abs, sums)) / window
        assert math.isnan(got[g, i]) if math.isnan(want) else math.isclose(got[g, i], want, rel_tol=1e-9, abs_tol=1e-9), (g, i)
