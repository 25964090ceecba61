"""Texts that are taken apart: once each, whatever is read of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import projections
from seriesloom.sources import files


def _plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_statistics_are_parsed_once(spark):
    rows = [
        ('{"statistics": [{"period": "1ST", "groups": [{"statisticsItems": [{"key": "a", "home": "0", "away": "0"}]}]}, {"period": "ALL", "groups": [{"statisticsItems": [{"key": "a", "home": "1", "away": "2"}, {"key": "b", "home": "3"}]}, {"statisticsItems": [{"key": "a", "home": "4", "away": "5"}, {"home": "6"}]}]}]}',),
        (None,),
        ('{"statistics": []}',),
    ]
    out = spark.createDataFrame(rows, "raw string").select(files.flatten_statistics(F.col("raw")).alias("m"))
    assert [r.m for r in out.collect()] == [{"b_home": "3", "a_home": "4", "b_away": None, "a_away": "5"}, None, {}]
    assert _plan(out).count("from_json(") == 1


def test_game_keys_are_cut_once(spark):
    rows = [("2024-01-02 A-B-C-D",), ("2024-01-02 A-X-Y",), ("2024-01-02 P-Q-R",), ("2024-01-02 A",), ("A-B",), (None,)]
    out = spark.createDataFrame(rows, "t string").select(projections.game_key(F.col("t"), ["A-B", "C-D", "A"]).alias("g"))
    got = [None if r.g is None else tuple(r.g) for r in out.collect()]
    assert got == [("2024-01-02", "A-B", "C-D"), ("2024-01-02", "A", "X-Y"), ("2024-01-02", "P-Q", "R"), None, None, None]
    assert _plan(out).count("split(") == 1
