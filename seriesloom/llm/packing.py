"""Best-fit packing of documents into token sequences.

Documents are encoded, closed by an end id, and cut into pieces only where they exceed
the capacity. The packing is bulk-synchronous best fit. Pieces are range-sorted by length and
open sequences by their gap; as both are whole numbers up to the capacity, a run (first rank,
count) stands for all neighbours of one size. The lengths are cut into bands, each down
to half of the last, and each band is one superstep, a Spark job:

1. Pieces of the band and gaps that may hold one are dealt to stripes by their ranks inside
   their size, so each stripe has its share of every length and of every gap.
2. In every stripe, in parallel, a successor sweep goes down the lengths: the pieces of a length take
   the smallest gap that holds them, those that want the same gap are served by rank, the
   losers go on to the next larger gap, and to new sequences where none is left.
3. The gaps that are left, and those that are new, are written; the next step deals them anew.

One stripe gives what best-fit-decreasing gives; there is one for each ``STRIPE`` pieces, at most
``STRIPES``. A length ends once in a stripe, and only then does a run of gaps break in two, so
the runs, and the placements that are broadcast in the end, number a few times capacity x
stripes x bands at most, whatever the input. Pieces themselves are numbered by a rank
inside salted lengths, and placed by a join with the placements.

Defined cases: null text is empty (one piece, the end id); repeated rows are packed each;
a piece of full length fills a sequence; ties go by doc_id, piece and content; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import scratch_path, staged, table
from .tokens import encoder, vocabulary_path

CAPACITY = 2048
END_ID = 0
#: Pieces of a length that are ranked together; pieces for each stripe; stripes at most.
RANKED, STRIPE, STRIPES = 1000, 1_000_000, 16
#: Bytes of ids that a task gives on together.
HELD = 4_000_000
#: Sequences that one stripe of one step may open.
OPENED = 1 << 40
STATE = "kind string, size long, first long, n long, each long, offset long, sequence long"


def split_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row's encoded text."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = END_ID.to_bytes(4, "little")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, held = [], 0
            for doc, code in zip(b["doc_id"], encoder(path, False).encode(b["text"]), strict=True):
                code += end
                for n, at in enumerate(range(0, len(code), 4 * capacity)):
                    part = code[at : at + 4 * capacity]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                held += len(code)
                if held > HELD:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return docs.mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sweep(pieces: Iterable[tuple[int, int, int]], gaps: Iterable[tuple[int, int, int]], opened: int, capacity: int) -> Iterator[tuple]:
    """Rows of STATE: placements of all pieces, and the gaps afterwards.

    pieces: (length, first rank, count), the longest first; gaps: (gap, first sequence,
    count); new sequences are numbered from ``opened`` on. A placement says that pieces of
    that length and of n ranks from the first on go to consecutive sequences, so many in each, one
    behind the other from the offset on."""
    runs: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(sizes, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for gap in gaps:
        add(*gap)
    for length, rank, count in pieces:
        while count:
            at = bisect_left(sizes, length)
            gap = sizes[at] if at < len(sizes) else capacity
            each = gap // length
            if at < len(sizes):
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], sizes[at]
            else:
                first, n = opened, -(-count // each)
                opened += n
            some = min(count, n * each)
            full, odd = divmod(some, each)
            yield "placed", length, rank, some, each, capacity - gap, first
            add(gap - each * length, first, full)
            add(gap - odd * length, first + full, min(odd, 1))
            used = full + min(odd, 1)
            add(gap, first + used, n - used)
            rank, count = rank + some, count - some
    for gap in sizes:
        yield from (("gap", gap, first, n, 0, 0, 0) for first, n in runs[gap])


def _sweep_stripes(step: int, capacity: int):
    """Sweeps of all stripes of a partition; rows come by stripe, the longest first."""
    names = [c.split()[0] for c in STATE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in b[["stripe", "kind", "size", "first", "n"]].itertuples(index=False)]
        for stripe in sorted({r.stripe for r in rows}):
            own = lambda kind: [(r.size, r.first, r.n) for r in rows if r.stripe == stripe and r.kind == kind]  # noqa: B023, E731
            found = sweep(own("piece"), own("gap"), (step * STRIPES + stripe) * OPENED, capacity)
            yield pd.DataFrame(list(found), columns=names)

    return run


def placements(lengths: DataFrame, capacity: int, stripes: int) -> DataFrame:
    """(length, from, to, each, offset, sequence) of all pieces, from (size, n): how many of each length."""
    spark = lengths.sparkSession
    path = scratch_path(spark, "sweeps")
    bands, high = [], capacity
    while high:
        bands.append((high // 2, high))
        high //= 2
    sizes = [r.size for r in lengths.select("size").distinct().collect()]  # no more than the capacity
    gaps = spark.createDataFrame([], STATE)
    for step, (low, high) in enumerate(bands):
        if not any(low < n <= high for n in sizes):
            continue
        band = lengths.where((F.col("size") > low) & (F.col("size") <= high))
        runs = band.select(F.lit("piece").alias("kind"), "size", F.lit(0).cast("long").alias("first"), "n")
        runs = runs.unionByName(gaps.where(F.col("size") > low).select("kind", "size", "first", "n"))
        # by rank inside a size: [begin, begin + n) of total, cut where the stripes' shares end
        same = W.partitionBy("kind", "size")
        begin = F.sum("n").over(same.orderBy("first").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
        runs = runs.withColumn("begin", begin).withColumn("total", F.sum("n").over(same))
        share = lambda i: F.floor(F.col("total") * i / stripes)
        runs = runs.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
        lo, hi = F.greatest("begin", share(F.col("stripe"))), F.least(F.col("begin") + F.col("n"), share(F.col("stripe") + 1))
        runs = runs.select("stripe", "kind", "size", (F.col("first") + lo - F.col("begin")).alias("first"), (hi - lo).alias("n")).where("n > 0")
        swept = runs.repartition(stripes, "stripe").sortWithinPartitions("stripe", F.desc("size"), "first").mapInPandas(_sweep_stripes(step, capacity), STATE)
        swept.unionByName(gaps.where(F.col("size") <= low)).write.parquet(f"{path}/step={step}")
        gaps = spark.read.schema(STATE).parquet(f"{path}/step={step}").where("kind = 'gap'")
    if not sizes:
        return spark.createDataFrame([], "length long, from long, to long, each long, offset long, sequence long")
    placed = spark.read.schema(STATE).parquet(f"{path}/step=*").where("kind = 'placed'")
    return placed.select(F.col("size").alias("length"), F.col("first").alias("from"), (F.col("first") + F.col("n")).alias("to"), "each", "offset", "sequence")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, per_stripe: int = STRIPE) -> DataFrame:
    """``pieces`` with sequence_id and offset added; needs doc_id, piece, start, length, ids_crc32."""
    columns = pieces.columns
    lengths = staged(pieces.groupBy("length").agg(F.count("*").alias("__all")), "lengths")  # rows: the capacity at most
    n = lengths.agg(F.sum("__all")).first()[0] or 0
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.ceil(F.col("__all") / RANKED))
    pieces = pieces.join(F.broadcast(lengths), "length").withColumn("__salt", salt).drop("__all")
    classes = pieces.groupBy("length", "__salt").agg(F.count("*").alias("__count"))
    before = W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    base = classes.select("length", "__salt", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__base"))
    plan = placements(lengths.select(F.col("length").alias("size"), F.col("__all").alias("n")), capacity, max(1, min(STRIPES, n // per_stripe)))
    order = W.partitionBy("length", "__salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("__n", F.row_number().over(order).cast("long") - 1)
    ranked = ranked.join(base, ["length", "__salt"]).withColumn("__rank", F.col("__base") + F.col("__n"))
    here = (F.col("p.length") == F.col("l.length")) & (F.col("__rank") >= F.col("l.from")) & (F.col("__rank") < F.col("l.to"))
    joined = ranked.alias("p").join(F.broadcast(plan).alias("l"), here)
    i = F.col("__rank") - F.col("l.from")
    return joined.select(
        *[F.col(f"p.{c}") for c in columns],
        (F.col("l.sequence") + F.floor(i / F.col("l.each"))).cast("long").alias("sequence_id"),
        (F.col("l.offset") + F.pmod(i, F.col("l.each")) * F.col("p.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    return pack_pieces(staged(split_documents(docs, path, capacity, with_ids), "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
