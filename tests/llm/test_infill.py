"""Fill-in-middle against plain strings, and rank and select against counting."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.llm.infill import SLICE, Boundaries, cut_points, fill_in_middle, restored

SIGNS = "aé€😀 \n"


def plain_rules(doc_id, text, salt="1"):
    text = text or ""
    x = hashlib.sha256(f"{salt}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def rows():
    r = random.Random(5)
    out = [(i, "".join(r.choice(SIGNS) for _ in range(r.choice([0, 1, 2, 7, 60, 700])))) for i in range(300)]
    out += [(7, "repeated"), (7, "repeated"), (7, "of one id"), (None, "no id"), (None, None), (400, None), (401, ""), (402, "has <S> mark"), (403, "<P>"), (404, "<p> < P>")]
    return [*out, (405, "é" * 400_001 + "😀")]


def test_every_row_as_by_plain_strings(spark):
    given = [(i, t, "form", 1) for i, t in rows()]
    df = spark.createDataFrame(given, "doc_id long, text string, output string, n int").repartition(5)
    got = sorted((tuple(r) for r in fill_in_middle(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=repr)
    assert got == sorted(((i, *plain_rules(i, t)) for i, t in rows()), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_restored(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    out = fill_in_middle(df, plain=0, spm=50)
    assert out.where(restored(F.col("output"), F.col("form")) != F.col("text")).count() == 0
    assert {r[0] for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_no_rows(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("size", [0, 1, 63, 64, 511, 512, 513, 5000, SLICE + 77])
def test_rank_and_select(size):
    raw = np.frombuffer("".join(random.Random(size).choices(SIGNS, k=size)).encode()[:size], dtype=np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    b = Boundaries(raw)
    at = np.unique(np.concatenate([[0, len(raw)], np.random.default_rng(1).integers(0, size + 1, 200)]))
    assert b.rank(at).tolist() == np.searchsorted(starts, at).tolist()
    which = np.arange(len(starts))[:: max(1, len(starts) // 3000)]
    assert b.select(which).tolist() == starts[which].tolist()


def test_slices_of_an_array():
    texts = pa.array(["x", "éé", "€uro", ""]).slice(1)
    got = cut_points(texts, np.array([1, 5, 9]), np.array([2, 2, 9])).to_pylist()
    assert [tuple(g.values()) for g in got] == [(2, 1, 1, 2, 4), (4, 0, 2, 0, 4), (0, 0, 0, 0, 0)]
