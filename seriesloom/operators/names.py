"""Names from several sources brought to one spelling, by joins with a dictionary table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that Unicode doesn't decompose, and what they are without their mark.
LETTERS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("đ", "d"), ("ð", "d"), ("ł", "l"), ("ı", "i"), ("þ", "th"), ("Æ", "AE"), ("Œ", "OE"), ("Ø", "O"), ("Đ", "D"), ("Ð", "D"), ("Ł", "L"), ("Þ", "Th"))


def unaccented(name: Column) -> Column:
    """The name in its canonical decomposition (ICU, which Spark ships) without combining marks."""
    plain = F.regexp_replace(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), name, F.lit(False)), r"\p{M}+", "")
    for a, b in LETTERS:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    # in ASCII there is nothing to take off
    return F.when(F.octet_length(name) == F.char_length(name), name).otherwise(F.when(name.isNotNull(), plain))


def dictionary(explicit: DataFrame, known: DataFrame) -> DataFrame:
    """(key, layer, target) of a table of aliases (alias, name) and one of known names (name): one row for each key and layer.

    Layers, first wins: an alias as it is; an alias met by a name without accents; a known name as it is; a known name, both
    without accents. Of several targets of one key the smallest is taken."""
    a = explicit.select(F.trim("alias").alias("key"), F.explode(F.array(F.lit(1), F.lit(2))).alias("layer"), F.col("name").alias("target"))
    k = known.select(F.trim("name").alias("name")).distinct()
    k = k.select(F.explode(F.array(F.struct(F.col("name").alias("key"), F.lit(3).alias("layer")), F.struct(unaccented(F.col("name")).alias("key"), F.lit(4).alias("layer")))).alias("x"), F.col("name").alias("target"))
    every = a.unionByName(k.select("x.*", "target")).where("key <> '' and target is not null")
    return every.groupBy("key", "layer").agg(F.min("target").alias("target"))


def resolve(df: DataFrame, column: str, words: DataFrame, out: str) -> DataFrame:
    """df with ``out``: the name in ``column`` by the dictionary ``words``, or itself, trimmed, if that holds nothing of it.

    Distinct names alone meet the dictionary, on equal keys; their targets come back by one join, in which Spark broadcasts
    what is small. Null stays null."""
    names = df.select(F.trim(F.col(column)).alias("__name")).where("__name is not null").distinct()
    keys = names.select("__name", F.explode(F.array(*[F.struct(k.alias("key"), F.lit(layer).alias("layer")) for layer, k in ((1, F.col("__name")), (2, unaccented(F.col("__name"))), (3, F.col("__name")), (4, unaccented(F.col("__name"))))])).alias("x"))
    hits = keys.select("__name", "x.*").join(words, ["key", "layer"]).groupBy("__name").agg(F.min_by("target", "layer").alias("__target"))
    named = df.withColumn("__name", F.trim(F.col(column)))
    return named.join(hits, "__name", "left").withColumn(out, F.coalesce("__target", "__name")).drop("__name", "__target")


def registered(df: DataFrame, registry: DataFrame, name: str, tier: int | None = None) -> DataFrame:
    """Rows whose ``name`` the registry (name, tier, ...) holds, of one tier if told, with the registry's other columns; a name
    that it holds twice is an error of the registry and matches its first row."""
    r = registry.where(F.col("tier") == tier) if tier is not None else registry
    more = [c for c in r.columns if c not in df.columns and c != name]
    one = r.groupBy(name).agg(F.min(F.struct(*more)).alias("__r")) if more else r.select(name).distinct()
    out = df.join(one, name)
    return out.select(*df.columns, *[F.col(f"__r.{c}").alias(c) for c in more])
