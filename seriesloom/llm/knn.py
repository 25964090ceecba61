"""Exact top-k search as a Voronoi kNN join for the inner product.

Vectors become whole numbers, floor(1024 * x) of each component. A sample of about
2 sqrt(n) vectors are pivots (the zero vector, in dimensions that it doesn't hold); every vector joins
the cell of its nearest pivot. A cell's summary is its pivot, its rows, their least and largest
distance from the pivot, their largest norm and the k + 1 least distances. For a query q
and a vector x of the cell around p, at distance d from it,

    q.x >= q.p - |q| d
    q.x <= q.p + |q| d
    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2,   |q - x| >= | |q - p| - d |

and |q - x| is no less than the distance of q from the bisector of p and q's own pivot, beyond which
x lies. The k + 1 best lower bounds of all cells (more, if the query's own rows are several) give a
floor under the query's k-th score; a query is replicated only to the cells whose upper
bound reaches it. Those nearest to it that hold k others are solved first; their k-th score is a
better floor, which fewer cells reach, and of these only rows that reach it are given on. Cells are dealt out as blocks of bounded size, queries as blocks too, so
that a hot cell or many queries are many tasks; each block pair is solved by one
matrix product, and the blocks' best rows are merged. Pivots and summaries, which the
driver and all tasks hold, grow with the square root of the rows (60,000 of a billion).

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do
those without a vec_id; vectors are compared with those of their own dimension; components and
scores beyond the range of a long count as its end; ties go to the smaller vec_id; rows that
repeat a query's vec_id are its own and never its answers, and it asks once (by its least
vector); other repeated rows count each; fewer than k others give all of them; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import ship
from .common import staged, table

#: Rows of a block, about twice those of a mean cell inside these bounds; queries of a block.
LEAST_BLOCK, MOST_BLOCK, QUERY_BLOCK = 256, 8_192, 256
#: Slack on bounds computed in floating point, as a share of |p| |q|; cells of one matrix.
SLACK, CELLS = 1e-9, 2_000_000
LONG = 2**63


def quantised(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long"))


def sound(embedding: Column) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return embedding.isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in column])


def _chunks(n: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // max(width, 1))
    return (slice(at, at + step) for at in range(0, n, step))


def _squares(m: np.ndarray) -> np.ndarray:
    return (m * m).sum(1)


def _assign(pivots: dict[int, np.ndarray]):
    """pivots: the pivots of each dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, rows in b.groupby(b["v"].map(len)):
                m = _matrix(rows["v"]).astype(np.float64).reshape(len(rows), dim)
                p = pivots.get(dim, np.zeros((1, dim)))
                near = np.concatenate([(_squares(p)[None, :] - 2 * m[at] @ p.T).argmin(1) for at in _chunks(len(m), len(p))])
                yield rows.assign(dim=dim, cell=near, dist=np.sqrt(_squares(m - p[near])), norm=np.sqrt(_squares(m)))

    return run


def _route(cells: list, pivots: dict[int, np.ndarray], k: int):
    """Which cells can hold one of a query's k best."""
    by_dim: dict[int, tuple] = {}
    for dim in {c.dim for c in cells}:
        own = [c for c in cells if c.dim == dim]
        p = pivots.get(dim, np.zeros((1, dim)))[[c.cell for c in own]]
        near = np.array([(list(c.near) + [np.inf] * k)[: k + 1] for c in own])
        by_dim[dim] = (np.array([c.cell for c in own]), p, near, np.array([c.radius for c in own]), np.array([c.norm for c in own]), np.array([c.n for c in own]))

    def bounds(q: np.ndarray, own: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query and cell: the upper bound, whether it is solved first, and whether it may hold a result."""
        _, p, near, radius, norm, n = by_dim[dim]
        q2, p2 = _squares(q)[:, None], _squares(p)[None, :]
        length, mid = np.sqrt(q2), q @ p.T
        slack = SLACK * (length + norm[None, :]) * (np.sqrt(p2) + radius[None, :] + norm[None, :] + length) + 1e-6
        # the best k + own lower bounds lie in so many cells of the best first bounds
        low = mid - length * near[None, :, 0] - slack
        wanted = (k + own)[:, None]
        top = np.argsort(-low, axis=1)[:, : int(wanted.max())]
        rows = np.arange(len(q))[:, None]
        with np.errstate(invalid="ignore"):  # nothing times infinity, where a cell has fewer rows
            each = (mid[rows, top] - slack[rows, top])[:, :, None] - length[:, :, None] * near[top]
        each = -np.sort(-np.nan_to_num(each.reshape(len(q), -1), nan=-np.inf), axis=1)
        floor = np.where(wanted <= each.shape[1], np.take_along_axis(each, np.minimum(wanted, each.shape[1]) - 1, axis=1), -np.inf)[:, 0]
        away2 = np.maximum(q2 + p2 - 2 * mid, 0)
        away, home = np.sqrt(away2), away2.argmin(1)
        apart = np.sqrt(np.maximum(p2 + p2[0, home][:, None] - 2 * p[home] @ p.T, 1e-300))
        bisector = np.where(apart > 1e-3, (away2 - away2[rows[:, 0], home][:, None]) / (2 * np.maximum(apart, 1e-3)), 0)
        least = np.maximum.reduce([away - radius[None, :], near[None, :, 0] - away, bisector, np.zeros_like(away)])
        high = np.minimum(mid + length * radius[None, :], (q2 + norm[None, :] ** 2 - least**2) / 2) + slack
        # the nearest cells that hold k + own rows come first
        order = np.argsort(away2, axis=1)
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.empty(high.shape, dtype=bool)
        np.put_along_axis(first, order, before < wanted, axis=1)
        return high, first, (high >= floor[:, None]) | first

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, rows in b.groupby("dim"):
                q = _matrix(rows["v"]).astype(np.float64).reshape(len(rows), dim)
                ids, own, vectors = rows["vec_id"].to_numpy(), rows["own"].to_numpy(), rows["v"].to_numpy()
                for at in _chunks(len(q), len(by_dim[dim][0]) * (k + 2)):
                    high, first, may = bounds(q[at], own[at], dim)
                    i, c = np.nonzero(may)
                    yield pd.DataFrame({"query_id": ids[at][i], "dim": dim, "cell": by_dim[dim][0][c], "q": vectors[at][i], "first": first[i, c], "high": high[i, c]})

    return run


def _solve(k: int):
    def run(key: tuple, data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if data.empty or queries.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        data = data.sort_values("vec_id", kind="stable")
        ids, x, q = data["vec_id"].to_numpy(), _matrix(data["v"]), _matrix(queries["q"])
        widest = int(max(x.max(initial=0), -int(x.min(initial=0)))) * int(max(q.max(initial=0), -int(q.min(initial=0)))) * max(1, x.shape[1])
        exact = np.float64 if widest < 2**53 else object  # beyond it floats round: Python's integers
        x, q, out = x.astype(exact), q.astype(exact), []
        for at in range(0, len(q), 256):
            scores = q[at : at + 256] @ x.T
            for query, floor, s in zip(queries["query_id"].iloc[at : at + 256], queries["floor"].iloc[at : at + 256], scores, strict=True):
                s = s if exact is np.float64 else np.clip(s, -LONG, LONG - 1)
                keep = np.flatnonzero((ids != query) & (s >= floor))
                own = s[keep]
                if len(keep) > k:
                    bar = np.partition(own, len(own) - k)[len(own) - k] if exact is np.float64 else sorted(own)[-k]
                    keep, own = keep[own >= bar], own[own >= bar]
                best = np.argsort(-own, kind="stable")[:k]  # by vec_id inside a score
                out += [(query, ids[keep[i]], int(own[i])) for i in best]
        return pd.DataFrame(out, columns=columns).astype("int64")

    return run


def routed_queries(vectors: DataFrame, queries: DataFrame, k: int, pivots: int | None = None) -> tuple[DataFrame, DataFrame, list]:
    """The vectors with their cells, the queries with all cells they visit, and the summaries."""
    spark = vectors.sparkSession
    ship(spark)
    ready = lambda df: df.where(sound(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), quantised(F.col("embedding")).alias("v"))
    data, ask = ready(vectors), ready(queries)
    pivots = pivots or 2 * isqrt(data.count()) + 1
    by_dim: dict[int, np.ndarray] = {}
    for r in data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect():
        by_dim.setdefault(len(r.v), []).append(tuple(r.v))
    by_dim = {dim: np.array(sorted(set(own)), dtype=np.float64).reshape(-1, dim) for dim, own in by_dim.items()}
    held = staged(data.mapInPandas(_assign(by_dim), "vec_id long, v array<long>, dim int, cell int, dist double, norm double"), "vectors")
    first = W.partitionBy("dim", "cell").orderBy("dist")
    near = held.select("dim", "cell", "dist", F.row_number().over(first).alias("n")).where(F.col("n") <= k + 1)
    near = near.groupBy("dim", "cell").agg(F.sort_array(F.collect_list("dist")).alias("near"))  # k + 1 at most
    cells = held.groupBy("dim", "cell").agg(F.max("dist").alias("radius"), F.max("norm").alias("norm"), F.count("*").alias("n"))
    cells = cells.join(near, ["dim", "cell"]).collect()
    ask = ask.groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").cast("int").alias("own")).withColumn("dim", F.size("v"))
    ask = ask.join(F.broadcast(spark.createDataFrame([(d,) for d in {c.dim for c in cells}], "dim int")), "dim", "left_semi")
    return held, staged(ask.mapInPandas(_route(cells, by_dim, k), "query_id long, dim int, cell int, q array<long>, first boolean, high double"), "routed"), cells


def _solved(held: DataFrame, routed: DataFrame, cells: list, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each block that reach the query's floor."""
    spark = held.sparkSession
    # blocks: so many of a cell's rows, so many of the queries that visit it
    block = min(MOST_BLOCK, max(LEAST_BLOCK, 2 * sum(c.n for c in cells) // max(1, len(cells))))
    asks = {(r.dim, r.cell): r["count"] for r in routed.groupBy("dim", "cell").count().collect()}
    plan = [(c.dim, c.cell, -(-c.n // block), -(-asks.get((c.dim, c.cell), 0) // QUERY_BLOCK)) for c in cells]
    plan_df = F.broadcast(spark.createDataFrame(plan, "dim int, cell int, blocks long, query_blocks long"))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # rows that repeat one vec_id are dealt by their place in the table's files too
    x = held.join(plan_df, ["dim", "cell"]).where("query_blocks > 0").withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), "blocks"))
    x = x.withColumn("query_block", every("query_blocks"))
    q = routed.join(plan_df, ["dim", "cell"]).withColumn("query_block", deal("query_id", "query_blocks")).withColumn("block", every("blocks"))
    key = ["dim", "cell", "block", "query_block"]
    x, q = x.select(*key, "vec_id", "v"), q.select(*key, "query_id", "q", "floor")
    found = x.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(_solve(k), "query_id long, vec_id long, score long")
    return staged(found, "found")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of ``vectors`` for each of ``queries``; both (vec_id, embedding)."""
    held, routed, cells = routed_queries(vectors, queries, k, pivots)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = _solved(held, routed.where("first").withColumn("floor", F.lit(-LONG)), cells, k)
    floor = ranked(found).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = routed.where("not first").join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-LONG))).where("high >= floor")
    rest = staged(rest, "rest")
    return ranked(found.unionByName(_solved(held, rest, cells, k))).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for each vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
