"""Preferring joins with nulls, ties and clashing columns."""

from __future__ import annotations

from seriesloom.operators import matching


def test_namesakes(spark):
    left = spark.createDataFrame([(1, "a", " Ann ", 2020), (2, "a", "ANN", 2030), (3, "a", None, 2020), (4, "a", " ", 2020), (5, "b", "bob", None), (6, "b", "Cy", 2020), (1, "a", " Ann ", 2021)], "game int, team string, player string, season int")
    right = spark.createDataFrame([("ann", 2020, 5, "low", 9), ("Ann", 2021, 8, "high", 9), ("ann ", 2020, 6, "mid", 9), ("BOB", 2020, None, "none", 9), ("bob", None, 3, "bob", 9), (None, 2020, 99, "nobody", 9), ("", 2020, 99, "empty", 9)], "name string, version int, overall int, note string, game int")
    out = matching.preferred_match(left, right, ("player", "name"), ("season", "version"), "overall", ["game", "team", "player"], ["note"])
    assert out.columns == ["game", "team", "player", "season", "name", "version", "overall", "note"]
    assert sorted((r.game, r.season, r.note) for r in out.select("game", "season", "note").collect() if r.season) == [(1, 2021, "high"), (2, 2030, "high")]
    assert [(r.game, r.note) for r in out.where("season is null").collect()] == [(5, "bob")]
    assert matching.preferred_match(left, right.limit(0), ("player", "name"), ("season", "version"), "overall", ["game"]).count() == 0


def test_fine_before_coarse(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", None), (3, None, 10), (4, "b", 10), (5, "a", 11)], "id int, team string, game int")
    side = spark.createDataFrame([("a", 10, 1.0, 1), ("a", 10, 2.0, 2), ("a", 12, 3.0, 0), (None, 10, 9.0, 9), ("a", None, 7.0, 7)], "team string, game int, x double, t int")
    out = matching.two_level_lookup(left, {"s": (side, ["x"]), "e": (side.limit(0), ["x", "t"])}, ["team"], ["game"], ["t"])
    assert out.columns == ["id", "team", "game", "s_x", "e_x", "e_t"]
    assert sorted((r.id, r.s_x, r.e_x, r.e_t) for r in out.collect()) == [(1, 2.0, None, None), (2, 3.0, None, None), (3, None, None, None), (4, None, None, None), (5, 3.0, None, None)]
    # left, three sides: one shuffle
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_lookups_of_more_rows_have_more_tasks(spark, monkeypatch):
    """No fixed number of tasks sorts all rows: there are as many as the rows need."""
    monkeypatch.setattr(matching, "TASK_ROWS", 10, raising=False)
    left = spark.range(200).selectExpr("id", "id % 40 as team", "id as game")
    side = left.select("team", "game", "id").withColumnRenamed("id", "x")
    out = matching.two_level_lookup(left, {"s": (side, ["x"])}, ["team"], ["game"], rows=400)
    assert "hashpartitioning(team" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 40)" in plan
    assert out.where("s_x = id").count() == 200


def test_ratios_of_what_there_is(spark):
    df = spark.createDataFrame([(1, 0, 2)], "goals_from_fk int, shots_from_fk int, goals_conceded_from_setpieces int")
    out = matching.set_piece_ratios(df)
    assert out.columns[3:] == ["fk_effectiveness", "sp_defensive_vulnerability"] and tuple(out.first())[3:] == (None, 2.0)
