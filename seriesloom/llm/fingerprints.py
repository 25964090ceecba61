"""Document fingerprints: canonical exact digests, with Spark's own functions only.

A text's canonical form is its NFKC normalisation (ICU, which Spark ships), case-folded,
normalised again, with each run of white space one space and none at the ends. Its
fingerprint is wide: two xxhash64 values under different seeds, 32 hex digits. Hashes
are counted first; the canonical bytes of texts that share a fingerprint are then compared with those of the
first of them, so an accident of hashing never joins two texts. A fingerprint that very many
rows share is salted there. Likeness is 1.0 if the canonical bytes are equal and else 0.0.

Defined cases: null text is empty; an empty text has a fingerprint like any other; rows
that share a doc_id each get a result, and their next document is the one (smallest by the
characters that are taken of it, then by fingerprint) of the next larger doc_id; a null doc_id comes before all others; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import skewed_join, staged, table

LOWEST = -(2**63)
SPACE = r"\s\p{Z}\x1C-\x1F\x85"
#: Copies that are compared with one copy of their first text.
COMPARED = 1000
#: Ids in one window group at most, as a power of two.
FAN = 12


def nfkc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC, white space folding. ``text`` must not be null."""
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    # in ASCII there is nothing to normalise
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(nfkc(folded))
    # runs that are one space stay as they are
    return F.trim(F.regexp_replace(plain, f" [{SPACE}]+|[{SPACE}&&[^ ]][{SPACE}]*", " "))


def wide_hash(canon: Column) -> Column:
    """Two xxhash64 values under different seeds, as 32 hex digits."""
    half = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(half(canon), half(F.lit("second"), canon))


def successors(ids: DataFrame) -> DataFrame:
    """(k, next_k): the next larger k of a table of distinct longs; null after the largest.

    Windows over groups of at most 2**FAN neighbouring values; what lies beyond a group's
    end is the smallest value of the next group, found by the same step one level up."""
    low, high = ids.agg(F.min("k"), F.max("k")).first()
    levels, span = 0, 0 if low is None else high - low
    while span >> (FAN * (levels + 1)):
        levels += 1
    found = _successors(ids.withColumn("v", F.col("k")), levels)
    return found.select("k", "next_k")


def _successors(ids: DataFrame, levels: int) -> DataFrame:
    """(k, v, next_k), by the order of v; v narrows by FAN bits a level."""
    group = F.shiftright("v", FAN) if levels else F.lit(0).cast("long")
    ids = ids.withColumn("g", group)
    near = ids.withColumn("inner", F.lead("k").over(W.partitionBy("g").orderBy("v")))
    if not levels:
        return near.withColumnRenamed("inner", "next_k")
    heads = ids.groupBy("g").agg(F.min("k").alias("k"))
    above = _successors(heads.withColumn("v", F.col("g")), levels - 1).select("v", F.col("next_k").alias("outer")).withColumnRenamed("v", "g")
    return near.join(above, "g", "left").select("k", "v", F.coalesce("inner", "outer").alias("next_k"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    c = docs.select("doc_id", canonical(F.coalesce("text", F.lit(""))).alias("canon"))
    return c.select("doc_id", wide_hash(F.col("canon")).alias("fingerprint"))


def exact_groups(rows: DataFrame, total: int) -> DataFrame:
    """(k, t, name, group_id, group_size) of the rows (k, t, fp, size, canon) that share a
    fingerprint: equal ``canon`` has one name, and group_id is the smallest k among it."""
    first = rows.groupBy("fp").agg(F.min_by("canon", F.struct("k", "t")).alias("first"), F.max("size").alias("size"))
    salts = F.ceil(F.col("size") / COMPARED).cast("int")
    first = first.select("fp", "first", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    mine = rows.withColumn("salt", F.pmod(F.xxhash64("k", "t"), salts).cast("int"))
    # another text of the same hashes is named by its digest too
    name = F.concat("fp", F.when(F.col("canon") == F.col("first"), "").otherwise(F.sha2("canon", 256)))
    named = staged(mine.join(first, ["fp", "salt"]).select("k", "t", name.alias("name")), "named")
    groups = named.groupBy("name").agg(F.min("k").alias("group_id"), F.count("*").alias("group_size"))
    return skewed_join(named, groups, "name", "group_size", total)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, its edited text and its next document.

    Besides the contract's columns: the exact group of the document."""
    raw = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    docs = raw.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))
    hashed = staged(docs.select("k", "t", F.char_length("text").alias("n"), wide_hash(canonical(F.col("text"))).alias("fp")), "fingerprints")
    total = hashed.count()
    several = hashed.groupBy("fp").agg(F.count("*").alias("size")).where("size > 1")
    each = skewed_join(hashed, several, "fp", "size", total).withColumn("size", F.coalesce("size", F.lit(1)))
    each = each.groupBy("k", "t").agg(*[F.max(c).alias(c) for c in ("n", "fp", "size")])
    # who comes before k, and how many of k's first code points that one asks for
    sizes = hashed.groupBy("k").agg(F.max("n").alias("n"))
    asked = successors(sizes).join(sizes, "k").select(F.col("k").alias("p"), F.col("next_k").alias("k"), F.floor(F.col("n") / 4).cast("int").alias("want"))
    lowest = sizes.agg(F.min("k")).first()[0]
    asked = asked.withColumn("k", F.coalesce("k", F.lit(lowest)))  # after the last document comes the first
    asked = each.select("k", "t", F.col("fp").alias("next_fp")).join(asked, "k")
    # both uses of `docs` need the same columns by the same key, so Spark shuffles the texts once
    heads = docs.join(asked, ["k", "t"]).select("p", F.expr("left(text, want)").alias("head"), "next_fp", F.col("k").alias("next_k"), F.col("t").alias("next_t"))
    heads = heads.groupBy("p").agg(F.min(F.struct("head", "next_fp", "next_k", "next_t")).alias("h")).select(F.col("p").alias("k"), "h.*")
    both = docs.join(each.join(heads, "k"), ["k", "t"])
    cut_at = F.floor(F.col("n") / 4).cast("int")
    both = both.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n") - cut_at), F.expr("left(head, cast(floor(n / 4) as int))")))
    both = both.withColumn("edited_fp", wide_hash(canonical(F.col("edited"))))
    alike = (F.col("fp") == F.col("edited_fp")) & F.when(F.col("fp") == F.col("edited_fp"), canonical(F.col("text")) == canonical(F.col("edited")))
    out = both.select(
        "k", "t", "size", "fp", "edited_fp", "next_fp", "next_k", "next_t", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.coalesce(alike, F.lit(False)).alias("near_edited"), F.when(F.col("size") > 1, canonical(F.col("text"))).alias("canon"),
    )
    out = staged(out, "compared")
    groups = staged(exact_groups(out.where("size > 1").select("k", "t", "fp", "size", "canon"), total).distinct(), "groups")
    # a row and its next document are alike if their groups have one name
    nexts = groups.select(F.col("k").alias("next_k"), F.col("t").alias("next_t"), F.col("name").alias("next_name"))
    named = out.where("size > 1").drop("canon").join(groups, ["k", "t"]).join(nexts, ["next_k", "next_t"], "left")
    alone = out.where("size = 1").drop("canon").withColumns({"group_id": F.col("k"), "group_size": F.lit(1).cast("long"), "name": F.col("fp"), "next_name": F.lit(None).cast("string")})
    known = lambda c: F.nullif(c, F.lit(LOWEST))
    return named.unionByName(alone).select(
        known("k").alias("doc_id"), "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), F.col("near_edited").cast("double").alias("near_edited"),
        F.coalesce(F.col("name") == F.col("next_name"), F.lit(False)).cast("double").alias("near_next"), known("group_id").alias("group_id"), "group_size",
    )
