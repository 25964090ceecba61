"""Models, calibration and sequential operators by what they reach, or against plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import learning, projections, stateful
from seriesloom.plans import learning as plans
from seriesloom.sources import config, files, sinks

SF = "/root/testdata/sf0.001"


def test_calibration_helps(spark):
    got = {r.method: r.ece for r in plans.calibration_methods(spark, SF).collect()}
    assert got["platt"] < got["none"] and got["temperature"] < got["none"] and got["isotonic"] < got["none"]


def test_selector_takes_the_least(spark):
    rows = plans.selected_calibration(spark, SF).collect()
    best = min(rows, key=lambda r: r.ece)
    assert [r.method for r in rows if r.chosen] == [best.method] and best.method != "none"
    few = spark.createDataFrame([(1, [0.5, 0.5], 0)], "id long, p array<double>, y int")
    assert learning.select_calibration(few, "p", "y", ["id"]) == ("none", {})


def test_isotonic_is_monotone_and_whole(spark):
    r = random.Random(1)
    rows = [([p, 1 - p], int(r.random() > p * p)) for p in (r.random() for _ in range(300))]
    df = spark.createDataFrame(rows, "p array<double>, y int")
    fitted = learning.Isotonic().fit(df, "p", "y")
    got = sorted((x.p[0], x.q[0], sum(x.q)) for x in df.select("p", fitted.transform(F.col("p")).alias("q")).collect())
    assert all(a[1] <= b[1] + 1e-9 for a, b in zip(got, got[1:], strict=False)) and all(abs(s - 1) < 1e-9 for _, _, s in got)


def test_long_isotonic_curves(spark):
    """A curve of thousands of points is no part of the plan, and tells what a plain reading of it tells."""
    import numpy as np

    fitted = learning.Isotonic()
    at = [i / 20_000 for i in range(20_000)]
    fitted.curves = [(at, [x * x for x in at]), ([0.25], [0.5])]
    rows = [(x, 0.3) for x in (-1.0, 0.0, 0.12345, 0.5, 0.99999, 2.0, float("nan"))] + [(None, 0.3)]
    out = spark.createDataFrame(rows, "x double, z double").select("x", fitted.transform(F.array("x", "z")).alias("q"))
    assert len(out._jdf.queryExecution().analyzed().toString()) < 20_000
    for r in out.collect():
        v = at[0] ** 2 if r.x is None else at[-1] ** 2 if math.isnan(r.x) else float(np.interp(r.x, at, [x * x for x in at]))
        assert abs(r.q[0] - v / (v + 0.5)) < 1e-12 and abs(sum(r.q) - 1) < 1e-12


def test_ranked_equals_sorting(spark):
    r = random.Random(2)
    rows = [(r.randrange(50), i) for i in range(500)]
    got = {(x.a, x.b): x["__i"] for x in learning.ranked(spark.createDataFrame(rows, "a long, b long").repartition(7), ["a", "b"]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == sorted(rows) and sorted(got.values()) == list(range(500))


def test_stacking_and_daily_model(spark):
    s = plans.stacked_models(spark, SF).first()
    assert s.n > 100 and s.accuracy > 0.85 and s.log_loss < 0.5
    d = plans.daily_model(spark, SF)
    assert d.count() > 100 and d.where("p < 0 or p > 1 or p is null").count() == 0
    one = plans._features(spark, SF).withColumn("label", F.lit(1))
    assert learning.train_daily(one, ["a"], ["l_orderkey"], 2) is None
    with pytest.raises(ValueError):
        learning.create_model("no such model")


def test_equal_rows_are_stacked_as_one(spark, monkeypatch):
    """Base models of rows with many copies are those of the rows themselves, but each fit reads a fold's different rows once."""
    r = random.Random(6)
    few = [(x, y, int(x + y + r.uniform(-0.5, 0.5) > 1)) for x, y in ((r.random(), r.random()) for _ in range(60))]
    df = spark.createDataFrame([(i, *few[i * 7 % 60]) for i in range(1800)], "i int, a double, b double, label int").cache()
    seen, pipe = [], learning.pipeline
    monkeypatch.setattr(learning, "pipeline", lambda names, e: type("Seen", (), {"fit": lambda self, rows: seen.append(rows.count()) or pipe(names, e).fit(rows)})())
    model = learning.Stacking(["logistic", "tree"], ["a", "b"]).fit(df, ["i"])
    assert max(seen) <= 180 and seen[-3:] == [180, 180, 180]
    for name in ("logistic", "tree"):
        got, want = (learning.predict_proba(m, df.limit(60)).orderBy("i").collect() for m in (model.models[name], pipe(["a", "b"], learning.create_model(name)).fit(df)))
        assert max(abs(x.p[1] - y.p[1]) for x, y in zip(got, want, strict=True)) < 1e-4
    assert model.predict_proba(df).count() == 1800
    assert learning.Stacking(["forest", "prior"], ["a", "b"], 2).fit(df, ["i"]).predict_proba(df).where("p[0] + p[1] between 0.999 and 1.001").count() == 1800


def test_daily_model_reads_written_rows(spark, monkeypatch):
    """Neither the features nor what the model tells of them is computed again for each pass of a fit."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    seen, fit = [], learning.Platt.fit
    monkeypatch.setattr(learning.Platt, "fit", lambda self, df, p, y: seen.append(plan(df)) or fit(self, df, p, y))
    rows = plans._features(spark, SF)
    assert "Aggregate" not in plan(rows)
    learning.train_daily(rows, ["a", "b"], ["l_orderkey"], 2)
    assert len(seen) == 1 and "UDF" not in seen[0]


def test_leak_is_found(spark):
    got = {r.feature: r.verdict for r in plans.leak_signals(spark, SF).collect()}
    assert got["copy"] == "leaker" and got["c"] == "safe"


def test_stages_are_isolated(spark):
    df = spark.range(3)
    out, failed = projections.run_stages(df, [("double", lambda d: d.withColumn("x", F.col("id") * 2)), ("broken", lambda d: d.select("absent")), ("more", lambda d: d.withColumn("y", F.col("x") + 1))])
    assert out.columns == ["id", "x", "y"] and list(failed) == ["broken"]


def test_unique_join_refuses_repeated_keys(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "k long, v long")
    with pytest.raises(ValueError):
        projections.unique_join(spark.range(2).withColumnRenamed("id", "k"), df, ["k"])


def test_ordered_caps_equal_a_plain_loop(spark):
    r = random.Random(3)
    rows = [(i // 10, i, r.randrange(4), r.randrange(4), r.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "batch long, id long, home long, away long, stake double")
    got = {x.id: x.capped for x in stateful.team_caps(df, ["batch"], ["id"], "home", "away", "stake", 0.9).collect()}
    used: dict = {}
    for b, i, h, a, x in rows:
        take = max(0.0, min(x, 0.9 - used.get((b, h), 0.0), 0.9 - used.get((b, a), 0.0)))
        for t in {h, a}:
            used[b, t] = used.get((b, t), 0.0) + take
        assert math.isclose(got[i], take, abs_tol=1e-12)


def test_strata_are_exact_and_seeded(spark):
    rows = [(i, "abcd"[i % 3 if i % 7 else 3]) for i in range(997)]
    df = spark.createDataFrame([*rows, (5000, None)], "id long, y string")
    got = stateful.stratified(df, "y", "id", 0.1, 7).collect()
    count: dict = {}
    for _, y in [*rows, (0, None)]:
        count[y] = count.get(y, 0) + 1
    found: dict = {}
    for x in got:
        found[x.y] = found.get(x.y, 0) + 1
    assert found == {y: math.ceil(n * 0.1) for y, n in count.items()} and len({x.id for x in got}) == len(got)
    assert {x.id for x in stateful.stratified(df.repartition(5), "y", "id", 0.1, 7).collect()} == {x.id for x in got}


def test_sources_refuse_and_leave_out(spark, tmp_path):
    spark.range(2).selectExpr("id as A").write.option("header", True).csv(f"{tmp_path}/grp=x/period=1")
    spark.range(2).selectExpr("id as Team").write.option("header", True).csv(f"{tmp_path}/grp=x/period=2")
    args = (spark, str(tmp_path), (), ["Team"], None, r"grp=([^/]+)/period=([^/]+)/[^/]+\.csv$")
    assert {r.period for r in files.read_csv_files(*args).collect()} == {"2"}
    with pytest.raises(files.MissingColumns):
        files.read_csv_files(*args, strict=True)
    none = files.read_csv_files(*args[:4], {"grp": ["y"]}, args[5])
    assert none.columns == ["Team", "grp", "period"] and none.count() == 0
    with pytest.raises(ValueError):
        files.scan(spark, SF, "secrets", ["orders"])


def test_experiment_settings(spark, tmp_path):
    told = {"name": "a", "groups": ["x"], "seasons": ["2324"], "stakes": {"fraction": 0.5}}
    read = lambda change, name: sinks.write_text(spark, f"{tmp_path}/{name}", {**told, **change}) or config.read_experiment(spark, f"{tmp_path}/{name}")
    got = read({}, "good")
    assert got.stakes.fraction == 0.5 and got.seasons == ("2324",) and got.train_seasons == 3
    for n, change in enumerate(({"seasons": ["23"]}, {"stakes": {"fraction": 0}}, {"groups": []}, {"other": 1}, {"train_seasons": 0})):
        with pytest.raises(config.BadConfig):
            read(change, f"bad{n}")
