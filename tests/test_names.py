"""Names against a dictionary in layers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from seriesloom.operators import names


def test_letters_without_marks(spark):
    given = ["Beşiktaş", "Göztepe", "İstanbul", "Iğdır", "Șteaua", "Málaga", "Saint-Étienne", "Łódź", "Brøndby", "Straße", "Ægir", "plain", "", "été", None]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "x string").select(names.unaccented(F.col("x"))).collect()]
    fixed = dict(names.LETTERS)
    plain = lambda s: "".join(fixed.get(c, c) for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    assert got == [None if g is None else plain(g) for g in given]
    assert got[0] == "Besiktas" and got[2] == "Istanbul" and got[3] == "Igdir" and got[7] == "Lodz"


def test_layers(spark):
    explicit = spark.createDataFrame([("Man Utd", "Manchester United"), ("Saint-Etienne", "ASSE"), ("Beşiktaş", "Besiktas JK"), (None, "x"), ("z", None)], "alias string, name string")
    known = spark.createDataFrame([("Málaga",), ("Malagá",), ("Sevilla",), ("Man Utd",), (None,), ("  ",)], "name string")
    words = names.dictionary(explicit, known)
    given = {" Man Utd ": "Manchester United", "Saint-Étienne": "ASSE", "Beşiktaş": "Besiktas JK", "Besiktas": "Besiktas", "Malaga": "Malagá", "Málaga": "Málaga", "SEVILLA": "SEVILLA", "Sevílla": "Sevilla", "": "", "z": "z", "nobody": "nobody", None: None}
    df = spark.createDataFrame([(n, "key", "layer") for n in given] * 2, "n string, key string, layer string")
    out = names.resolve(df, "n", words, "target")
    assert out.columns == ["n", "key", "layer", "target"] and out.count() == 2 * len(given)
    assert {r.n: r.target for r in out.collect()} == given


def test_a_thousand_names(spark):
    known = spark.range(1000).select(F.concat(F.lit("Clúb Nº "), F.col("id")).alias("name"))
    words = names.dictionary(known.select(F.lit("x").alias("alias"), F.col("name")).limit(0), known)
    df = known.crossJoin(spark.range(20)).select(names.unaccented(F.col("name")).alias("n"), F.col("name").alias("want"))
    assert names.resolve(df, "n", words, "got").where("got = want").count() == 20_000


def test_registry(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4)], "league string, x int")
    registry = spark.createDataFrame([("a", 1, "A"), ("b", 2, "B"), (None, 1, "N"), ("a", 1, "A2")], "league string, tier int, long_name string")
    assert [tuple(r) for r in names.registered(df, registry, "league", 1).collect()] == [("a", 1, 1, "A")]
    assert sorted(tuple(r) for r in names.registered(df, registry, "league").collect()) == [("a", 1, 1, "A"), ("b", 2, 2, "B")]
