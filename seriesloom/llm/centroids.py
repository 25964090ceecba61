"""Centroid clustering (Lloyd's rounds) with Drake's adaptive distance bounds.

Each vector carries its centroid, an upper bound of its distance from it, lower bounds of the distances
from several next nearest centroids, nearest first, and one bound for all the rest. When centroids have
moved, the bounds are widened by the moves. A vector whose upper bound stays strictly below all lower
ones keeps its centroid without a distance being computed; else its own distance is computed, and
then those of the candidates whose bounds don't lie beyond it; only if the bound of the rest
doesn't either, all are. Distances that decide are exact whole numbers; the
bounds are floating point with a margin to the safe side, and a tie is never certified, so every assignment
is exact. How many bounds are carried adapts: as many as any vector
needed in the last round, at least an eighth of the centroids.

A round is one pass of Spark over the vectors. Its tasks write vectors with their bounds and, beside
them, sums of their clusters, which one aggregation joins; the driver holds centroids alone, a
number set by parameters. The last round's table is deleted when the next is complete.

Defined cases: vectors that are null, hold a null or non-finite component or have another dimension take no part,
nor do those longer than 2**30 when quantised, as their squared distances fit no long; fewer vectors than
centroids make as many centroids as vectors; equal vectors may start several
centroids, the larger of which stay empty and where they are; vectors without a vec_id are clustered, but start
no centroid unless all lack it; rows that share a vec_id count each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship
from .common import dropped, table
from .knn import quantised, sound

#: Length of a quantised vector at most; share by which bounds are widened for rounding.
LONGEST, MARGIN = 2.0**30, 1e-11
STATE = "part string, vec_id {id}, v array<bigint>, a int, upper double, near array<int>, low array<double>, rest double, n bigint, need int"


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(x).reshape(-1), kind))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of v from its own centroid, or from the one given."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def _over(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + MARGIN)


def _under(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - MARGIN)


class Bounds:
    """The bounds of a batch of vectors: centroid, upper bound, candidates with lower bounds, bound of the rest."""

    def __init__(self, a: np.ndarray, upper: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray):
        self.a, self.upper, self.near, self.low, self.rest = a, upper, near, low, rest

    @classmethod
    def scanned(cls, v: np.ndarray, centroids: np.ndarray, width: int) -> Bounds:
        """All distances, exact; ties to the smaller number."""
        d2 = np.stack([squared(v, c) for c in centroids], axis=1)
        order = np.argsort(d2, axis=1, kind="stable")
        d2 = np.take_along_axis(d2, order, axis=1)
        rest = _under(d2[:, width + 1]) if d2.shape[1] > width + 1 else np.full(len(v), np.inf)
        return cls(order[:, 0].astype(np.int32), _over(d2[:, 0]), order[:, 1 : width + 1].astype(np.int32), _under(d2[:, 1 : width + 1]), rest)

    def widened(self, moves: np.ndarray) -> None:
        """Centroids have moved by at most ``moves``."""
        self.upper = (self.upper + moves[self.a]) * (1 + MARGIN)
        # a bound that shrinks by a move is made smaller by what that subtraction may round off
        shrunk = lambda x, m: np.maximum(0.0, (x - m) - MARGIN * (x + m))
        self.low = shrunk(self.low, moves[self.near])
        finite = np.isfinite(self.rest)
        self.rest = np.where(finite, shrunk(np.where(finite, self.rest, 0.0), moves.max()), np.inf)

    def narrowed(self, width: int) -> None:
        """Only the ``width`` nearest candidates keep bounds of their own."""
        if self.near.shape[1] > width:
            self.rest = np.minimum(self.rest, self.low[:, width:].min(axis=1))
            self.near, self.low = self.near[:, :width], self.low[:, :width]

    def settle(self, v: np.ndarray, centroids: np.ndarray) -> int:
        """Makes every assignment exact; returns how many candidates any vector needed."""
        floor = np.minimum(self.low.min(axis=1, initial=np.inf), self.rest)
        open_ = np.flatnonzero(self.upper >= floor)
        if not len(open_):
            return 0
        own = squared(v[open_], centroids[self.a[open_]])
        self.upper[open_] = _over(own)
        # the last candidate whose bound isn't beyond the vector's own distance
        reach = self.low[open_] <= self.upper[open_][:, None]
        width = self.near.shape[1]
        need = np.where(reach.any(axis=1), width - np.argmax(reach[:, ::-1], axis=1), 0) if width else np.zeros(len(open_), int)
        all_ = self.rest[open_] <= self.upper[open_]
        if all_.any():
            at = open_[all_]
            b = Bounds.scanned(v[at], centroids, width)
            self.a[at], self.upper[at], self.near[at], self.low[at], self.rest[at] = b.a, b.upper, b.near, b.low, b.rest
        for m in np.unique(need[~all_ & (need > 0)]):
            mine = ~all_ & (need == m)
            self._sorted_anew(open_[mine], v, centroids, own[mine], int(m))
        return int(max(need[~all_].max(initial=0), width * all_.any()))

    def _sorted_anew(self, at: np.ndarray, v: np.ndarray, centroids: np.ndarray, own: np.ndarray, m: int) -> None:
        """The first m candidates of the rows ``at`` and their own centroid by exact distances."""
        who = np.concatenate([self.a[at][:, None], self.near[at, :m]], axis=1)
        d2 = np.stack([own, *[squared(v[at], centroids[who[:, i]]) for i in range(1, m + 1)]], axis=1)
        by_number = np.argsort(who, axis=1)
        who, d2 = np.take_along_axis(who, by_number, 1), np.take_along_axis(d2, by_number, 1)
        order = np.argsort(d2, axis=1, kind="stable")
        who, d2 = np.take_along_axis(who, order, 1), np.take_along_axis(d2, order, 1)
        self.a[at], self.upper[at] = who[:, 0], _over(d2[:, 0])
        near, low = np.concatenate([who[:, 1:], self.near[at, m:]], axis=1), np.concatenate([_under(d2[:, 1:]), self.low[at, m:]], axis=1)
        order = np.argsort(low, axis=1, kind="stable")
        self.near[at], self.low[at] = np.take_along_axis(near, order, 1), np.take_along_axis(low, order, 1)


def _round(path: str, df: DataFrame, kind: str, dim: int, centroids: np.ndarray, moves: np.ndarray | None, width: int) -> None:
    """Assigns every vector and writes vectors with bounds, and sums of clusters, to folders of ``path``."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, need, ids = np.zeros((k, dim), dtype=object), np.zeros(k, dtype=np.int64), 0, None
        for batch in batches:
            ids, m = batch.column("vec_id"), batch.num_rows
            if not m:
                continue
            v = _matrix(batch.column("v"), dim, np.int64)
            if moves is None:
                b = Bounds.scanned(v, centroids, width)
            else:
                held = len(batch.column("near")[0])
                col = lambda c: batch.column(c).to_numpy(zero_copy_only=False).copy()  # noqa: B023, E731
                b = Bounds(col("a"), col("upper"), _matrix(batch.column("near"), held, np.int32).copy(), _matrix(batch.column("low"), held, np.float64).copy(), col("rest"))
                b.widened(moves)
                need = max(need, b.settle(v, centroids))
                b.narrowed(width)
            for c in np.unique(b.a):
                mine = b.a == c
                # halves, so that no sum of a batch leaves the range of a long
                high, low = v[mine] >> 16, v[mine] & 0xFFFF
                sums[c] += high.sum(axis=0).astype(object) * 65536 + low.sum(axis=0).astype(object)
                counts[c] += int(mine.sum())
            none = np.zeros(m, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["vectors"] * m), ids, batch.column("v"), pa.array(b.a), pa.array(b.upper), _lists(b.near, pa.int32()), _lists(b.low, pa.float64()), pa.array(b.rest), pa.array(none), pa.array(none.astype(np.int32))],
                names=names,
            )
        if ids is None:
            return
        at = np.flatnonzero(counts)
        # a sum of many long vectors may need two longs: high and low halves, each a row
        for half in (0, 1):
            part = np.array([[int(x) >> 31 if half else int(x) & 0x7FFFFFFF for x in sums[c]] for c in at], dtype=np.int64).reshape(len(at), dim)
            z = np.zeros(len(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"sums{half}"] * len(at)), pa.nulls(len(at), ids.type), _lists(part, pa.int64()), pa.array(at.astype(np.int32)), pa.array(z), _lists(np.zeros((len(at), 0)), pa.int32()), _lists(np.zeros((len(at), 0)), pa.float64()), pa.array(z), pa.array(counts[at]), pa.array(np.full(len(at), need, dtype=np.int32))],
                names=names,
            )

    schema = STATE.format(id=kind)
    names = [c.split()[0] for c in schema.split(", ")]
    df.mapInArrow(run, schema).write.partitionBy("part").parquet(path)


def _means(spark: SparkSession, path: str, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Floors of the clusters' means, and how many candidates were needed. Clusters times components, rows on the driver."""
    new, need, totals = centroids.copy(), 0, {}
    sums = spark.read.parquet(path).where("part <> 'vectors'")
    flat = sums.select("part", "a", "n", "need", F.posexplode("v").alias("i", "x"))
    flat = flat.groupBy("part", "a", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.max("need").alias("need"))
    for r in flat.collect():
        total, _ = totals.get((r.a, r.i), (0, 0))
        totals[r.a, r.i] = total + (int(r.x) << 31 if r.part == "sums1" else int(r.x)), int(r.n)
        need = max(need, r.need)
    for (a, i), (total, n) in totals.items():
        new[a, i] = total // n
    return new, need


def cluster(vectors: DataFrame, dim: int = 64, k: int = 8, rounds: int = 10, salt: str = "3") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that takes part of (vec_id, embedding), and the last centroids.

    The first centroids are the k vectors of the smallest sha256 of ``salt:vec_id``. ``distance`` is squared."""
    spark = vectors.sparkSession
    ship(spark)
    kept = vectors.where(F.size("embedding") == dim).where(sound(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("v"))
    long_ = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    kept = kept.where(long_ <= LONGEST**2)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    hashed = kept.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    centroids = np.array([r.v for r in hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()], dtype=np.int64)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint"), []
    least = -(-len(centroids) // 8)
    width = min(len(centroids) - 1, max(1, len(centroids) // 4))
    moves, before, state = None, None, kept
    for _ in range(rounds):
        path = scratch_path(spark, "clusters")
        _round(path, state, kind, dim, centroids, moves, width)
        if before:
            dropped(spark, before)
        new, need = _means(spark, path, centroids)
        moves, width = _over(squared(new, centroids)), min(width, max(least, need)) if moves is not None else width
        state, before, centroids = spark.read.schema(STATE.format(id=kind)).parquet(path).where("part = 'vectors'").drop("part"), path, new

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), dim, np.int64)
            if moves is None:
                a = Bounds.scanned(v, centroids, 0).a
            else:
                held = len(batch.column("near")[0])
                col = lambda c: batch.column(c).to_numpy(zero_copy_only=False).copy()  # noqa: B023, E731
                b = Bounds(col("a"), col("upper"), _matrix(batch.column("near"), held, np.int32).copy(), _matrix(batch.column("low"), held, np.float64).copy(), col("rest"))
                b.widened(moves)
                b.settle(v, centroids)
                a = b.a
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(a), pa.array(squared(v, centroids[a]))], names=["vec_id", "cluster", "distance"])

    path = scratch_path(spark, "assigned")
    state.mapInArrow(last, f"vec_id {kind}, cluster int, distance bigint").write.parquet(path)
    if before:
        dropped(spark, before)
    return spark.read.parquet(path), centroids.tolist()


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, squared distance, inertia and centroid digest of every vector that takes part."""
    out, centroids = cluster(table(spark, sf_dir, "embeddings"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    digests = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    per = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x"))
    fits = lambda x: F.expr(f"try_cast({x} as bigint)")
    # a row for each centroid
    told = per.crossJoin(F.broadcast(per.agg(F.sum("x").alias("y")))).join(digests, "cluster").select("cluster", fits("x").alias("cluster_inertia"), fits("y").alias("inertia"), "centroid_sha256")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """All rounds written out; a centroid and a vector are lists of longs."""
    step = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    out = f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INT) AS n, v FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM x ORDER BY h, v LIMIT {k}))"""
    for t in range(rounds + 1):
        out += f""",
a{t} AS MATERIALIZED (SELECT r, min(s).n AS n, min(s).d AS d FROM (SELECT x.r, {{'d': {step}, 'n': c.n}} AS s FROM x, c{t} AS c) GROUP BY r)"""
        if t < rounds:
            out += f""",
c{t + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.v, c.v) AS v FROM c{t} AS c LEFT JOIN (SELECT n, list(w ORDER BY i) AS v FROM (
  SELECT n, i, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS w FROM (SELECT a.n, unnest(x.v) AS e, generate_subscripts(x.v, 1) AS i FROM x JOIN a{t} AS a USING (r)) GROUP BY n, i) GROUP BY n) AS m USING (n))"""
    return f"""{out}
SELECT x.vec_id, a.n AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.n) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM x JOIN a{rounds} AS a USING (r) JOIN c{rounds} AS c ON c.n = a.n"""


OP12_SQL = _sql()
