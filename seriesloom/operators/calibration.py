"""Calibration curves of many groups at once: each step is one pass over the rows, summed by batches, however many groups and classes there are."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import metrics

CLIP = 1e-6
#: Logits are held to this range.
LOGIT = 15.0


def logit(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.least(F.greatest(F.ln(c / (1 - c)), F.lit(-LOGIT)), F.lit(LOGIT))


def _params(df: DataFrame, by: str, found: dict) -> DataFrame:
    """A row for each group, with what was found for it."""
    kind = df.schema[by].dataType.simpleString()
    rows = [(g, [float(x) for x in v]) for g, v in found.items()]
    return F.broadcast(df.sparkSession.createDataFrame(rows, f"{by} {kind}, __v array<double>"))


def _summed(df: DataFrame, ps: list[Column], y: Column, by: str, known: dict, told: Callable, width: int) -> list:
    """(group, class, sums) of the groups in ``known``: ``told(v, p, y)`` gives an array (rows, classes, width) for rows with what is
    known of each one's group, their probabilities (NaN where ``ps`` are null) and classes. Batches sum it by group, Spark sums the batches."""
    ship(df.sparkSession)
    kind = df.schema[by].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            code, groups = pd.factorize(b["g"])
            v = told(np.array([known[g] for g in groups])[code], b[names].to_numpy("float64"), b["y"].to_numpy("float64"))
            sums = np.stack([np.bincount(code, w, len(groups)) for w in v.reshape(len(b), -1).T], axis=1).reshape(-1, v.shape[2])
            yield pd.DataFrame({"g": np.repeat(groups, v.shape[1]), "k": np.tile(np.arange(v.shape[1]), len(groups)), "v": list(sums)})

    names = [f"p{k}" for k in range(len(ps))]
    flat = df.select(F.col(by).alias("g"), *[c.alias(n) for c, n in zip(ps, names, strict=True)], y.cast("double").alias("y")).where("g is not null and y is not null")
    sums = flat.mapInPandas(each, f"g {kind}, k int, v array<double>").groupBy("g", "k").agg(*[F.sum(F.get("v", F.lit(i))) for i in range(width)])
    return [(r[0], r[1], list(r[2:])) for r in sums.collect()]  # a row for each group and class


def fit_platt(df: DataFrame, p: str, y: str, by: str, steps: int = 40, tolerance: float = 1e-10) -> dict:
    """{group: [slope of class 0, intercept of class 0, slope of class 1, ...]}: logistic curves over the logit of each class
    against the rest, by Newton steps. A step that makes a curve worse is halved. A curve whose classes are told apart
    without error has no best slope; it stays where the steps end."""
    first = df.select(F.size(p)).first()
    if first is None:
        return {}
    n = first[0]
    groups = [r[0] for r in df.select(by).distinct().collect()]
    now = {(g, k): [1.0, 0.0] for g in groups for k in range(n)}
    best: dict = {}
    open_ = set(now)
    ps = [F.when(F.size(p) > k, F.least(F.greatest(F.get(p, F.lit(k)), F.lit(CLIP)), F.lit(1 - CLIP))) for k in range(n)]
    for _ in range(steps):
        curves = {g: [now[g, k] for k in range(n)] for g in {g for g, _ in open_}}
        rows = df if len(curves) == len(groups) else df.where(F.col(by).isin(list(curves)))
        for g, k, sums in _summed(rows, ps, F.col(y), by, curves, _newton_terms, 7):
            key = (g, k)
            if key not in open_:
                continue
            m, loss, ga, gb, haa, hab, hbb = sums
            a, b = now[key]
            if key in best and loss > best[key][0] + 1e-9 * m:
                _, u, v = best[key]
                now[key] = [(a + u) / 2, (b + v) / 2]
                continue
            best[key] = (loss, a, b)
            ridge = 1e-12 * m
            det = (haa + ridge) * (hbb + ridge) - hab**2
            if max(abs(ga), abs(gb)) <= tolerance * m or det <= 0 or not math.isfinite(det):
                open_.discard(key)
                continue
            now[key] = [a - ((hbb + ridge) * ga - hab * gb) / det, b - ((haa + ridge) * gb - hab * ga) / det]
        if not open_:
            break
    return {g: sum((list(best[g, k][1:]) for k in range(n)), []) for g in groups if (g, 0) in best}


def _newton_terms(curve: np.ndarray, p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row and class: one, loss, gradient and Hessian of the curve; nothing for a class that a row lacks."""
    x = np.clip(np.log(p / (1 - p)), -LOGIT, LOGIT)
    t = (y[:, None] == np.arange(p.shape[1])).astype("float64")
    z = curve[:, :, 0] * x + curve[:, :, 1]
    e = np.exp(-np.abs(z))
    s = np.where(z >= 0, 1, e) / (1 + e)
    # log(1 + e^z) - t z, without overflow
    loss = np.maximum(z, 0) + np.log1p(e) - t * z
    w, off = s * (1 - s), s - t
    return np.where(np.isnan(x)[:, :, None], 0, np.stack([np.ones_like(x), loss, off * x, off, w * x * x, w * x, w], axis=2))


def fit_temperature(df: DataFrame, p: str, y: str, by: str) -> dict:
    """{group: [T]} of the least log loss of softmax(log p / T): three grids, each one pass over the rows of all groups."""
    classes = df.agg(F.max(F.size(p))).first()[0]
    if classes is None:
        return {}
    n = 24
    groups = [r[0] for r in df.select(by).distinct().collect()]
    span = {g: (0.05, 20.0) for g in groups}
    best: dict = {}
    ps = [F.greatest(F.get(p, F.lit(k)), F.lit(CLIP)) for k in range(classes)]
    # a row with NaN tells nothing of T
    rows = df.where(~functools.reduce(operator.or_, [F.isnan(x) for x in ps]))
    ps = [F.when(F.size(p) > k, x) for k, x in enumerate(ps)]
    for _ in range(3):
        grid = {g: [low * (high / low) ** (i / (n - 1)) for i in range(n)] for g, (low, high) in span.items()}
        for g, _, loss in _summed(rows, ps, F.col(y).cast("int"), by, grid, _grid_terms, n):
            at = min(range(n), key=lambda i: loss[i])  # noqa: B023
            span[g] = (grid[g][max(at - 1, 0)], grid[g][min(at + 1, n - 1)])
            best[g] = [grid[g][at]]
    return best


def _grid_terms(grid: np.ndarray, p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row and temperature: the log loss of the row's class; nothing for a row without a class."""
    z = np.log(p)
    z = np.where(np.isnan(z), -np.inf, z)
    z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(z)), np.clip(y, 0, p.shape[1] - 1).astype("int64")]
    total = sum(np.exp(z[:, k : k + 1] / grid) for k in range(z.shape[1]))
    actual = np.exp(own[:, None] / grid) / total
    loss = -np.log(np.clip(actual, metrics.CLIP, 1 - metrics.CLIP))
    out = (y < 0) | (y >= p.shape[1]) | np.isinf(own)
    return np.where(out[:, None], 0, loss)[:, None, :]


def renormalised(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 0, F.transform(p, lambda x: F.try_divide(x, total))).otherwise(F.transform(p, lambda x: F.lit(1.0) / F.size(p)))


def platt_curve(p: Column, v: Column) -> Column:
    return renormalised(F.transform(p, lambda x, k: 1 / (1 + F.exp(-(F.element_at(v, 2 * k + 1) * logit(x) + F.element_at(v, 2 * k + 2))))))


def temperature_curve(p: Column, v: Column) -> Column:
    z = F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(CLIP))))
    top = F.array_max(z)
    return renormalised(F.transform(z, lambda x: F.exp((x - top) / v[0])))


#: Fit of all groups, and the curve of its result.
GROUPED = {"platt": (fit_platt, platt_curve), "temperature": (fit_temperature, temperature_curve)}


def calibrated(df: DataFrame, p: str, by: str, name: str, found: dict) -> DataFrame:
    """df with ``p`` calibrated by its group's curve; groups without one drop out."""
    told = df.join(_params(df, by, found), by)
    return told.withColumn(p, GROUPED[name][1](F.col(p), F.col("__v"))).drop("__v")


def scores(parts: dict[str, DataFrame], p: str, y: str, by: str, bins: int) -> dict[str, dict]:
    """{method: {group: mean classwise ECE}} of several calibrated frames, in one job."""
    every = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("__m"), by, F.posexplode(p).alias("k", "__p"), F.col(y).alias("__y"))
        every = one if every is None else every.unionByName(one)
    cells = metrics.ece(every, F.col("__p"), F.col("k") == F.col("__y"), ["__m", by, "k"], bins)
    out: dict = {name: {} for name in parts}
    for r in cells.groupBy("__m", by).agg(F.avg("ece").alias("ece")).collect():
        out[r[0]][r[1]] = r.ece
    return out
