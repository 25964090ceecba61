"""Top-k search against brute force and its SQL."""

from __future__ import annotations

import math
import random

import pytest

from seriesloom.llm.knn import OP4_SQL, op4_top_k, routed_queries, top_k
from tests.oracle import difference

SCHEMA = "vec_id long, embedding array<double>, score string, rank string, dim string, v string"
LONG = 2**63


def brute(rows: list[tuple], k: int, asks) -> set[tuple]:
    clip = lambda x: max(-LONG, min(LONG - 1, x))
    fine = [(i, [clip(math.floor(1024 * x) if abs(1024 * x) < math.inf else (LONG if x > 0 else -LONG)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for query in {i for i, _ in fine if asks(i)}:
        q = min(v for i, v in fine if i == query)
        scores = [(-clip(sum(a * b for a, b in zip(q, v, strict=True))), i) for i, v in fine if i != query and len(v) == len(q)]
        out |= {(query, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def clustered(n: int, dim: int, centres: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    mid = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [(i, [x + r.gauss(0, 0.05) for x in r.choice(mid)]) for i in range(n)]


def odd() -> list[tuple]:
    r = random.Random(7)
    rows = clustered(300, 5, 6, 1) + [(1000 + i, [r.choice([0.0, 1.0, -1.0]) for _ in range(5)]) for i in range(60)]  # ties
    rows += rows[:20] + [(i, [0.5] * 5) for i in range(4)]  # repeated rows, and ids of several vectors
    rows += [(2000 + i, [float(i), -1.0]) for i in range(4)] + [(3000, [2.0]), (3001, []), (3002, [])]
    rows += [(None, [1.0] * 5), (4000, None), (4001, [1.0, None, 0.0, 0.0, 0.0]), (4002, [math.nan] * 5), (4003, [math.inf] * 5)]
    rows += [(2**60 + 1, [3.0] * 5), (2**60 + 2, [3.0] * 5), (5000, [1e300, 1.0, 0.0, 0.0, 0.0]), (5001, [-1e300, 1e15, 0.0, 0.0, 0.0])]
    return rows


@pytest.mark.parametrize("pivots", [None, 3, 200])
def test_equals_brute_force(spark, pivots):
    rows = odd()
    df = spark.createDataFrame([(*r, "s", "r", "d", "v") for r in rows], SCHEMA)
    asks = lambda i: i % 7 < 4
    got = top_k(df, df.where("vec_id % 7 < 4"), 4, pivots).collect()
    assert len(got) == len(set(got)) or len(rows) != len(set(map(str, rows)))
    want = brute(rows, 4, asks)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_clusters_are_pruned(spark):
    rows = clustered(4000, 16, 30, 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    some = df.where("vec_id % 100 = 0")
    held, routed, cells = routed_queries(df, some, 10)
    size = {(c.dim, c.cell): c.n for c in cells}
    share = sum(size[r.dim, r.cell] for r in routed.collect()) / (len(rows) * some.count())
    print("scored share of all pairs:", round(share, 3))
    assert share < 0.25
    assert {tuple(r) for r in top_k(df, some).collect()} == brute(rows, 10, lambda i: i % 100 == 0)


def test_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(i, v) for i, v in clustered(600, 8, 5, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert difference(op4_top_k(spark, str(tmp_path)), con, OP4_SQL) == ""


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_k(df, df).collect() == []
