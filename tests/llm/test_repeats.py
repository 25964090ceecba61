"""Suffix-array dedup against a table of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from seriesloom.llm import repeats
from seriesloom.llm.repeats import _covered, remove_repeats, window_owners


def plain(rows, width):
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: -(2**63) if i is None else i
    for i, t in texts:
        for a in range(len(t) - width + 1):
            w = t[a : a + width]
            least[w] = min(least.get(w, rank(i)), rank(i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - width + 1):
            if least[t[a : a + width]] < rank(i):
                gone[a : a + width] = b"\1" * width
        spans, a = [], 0
        while a < len(t):
            b = a
            while b < len(t) and gone[b] == gone[a]:
                b += 1
            if gone[a]:
                spans.append((a, b))
            a = b
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), tuple(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df, **how):
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(df, **how).collect()), key=repr)


def some_text(r, n, signs="abcdé"):
    return "".join(r.choice(signs) for _ in range(n))


def library(seed, many=120):
    """Texts of shared passages, copies and own words, with odd rows between."""
    r = random.Random(seed)
    passages = [some_text(r, r.choice([40, 49, 50, 51, 90, 200])) for _ in range(12)]
    rows = []
    for i in range(many):
        parts = [r.choice(passages) if r.random() < 0.5 else some_text(r, r.choice([1, 5, 30, 120])) for _ in range(r.choice([1, 2, 6]))]
        rows.append((r.randrange(many), "".join(parts)))
    rows += [(i + many, rows[i][1]) for i in range(20)] + rows[:5]
    rows += [(None, rows[3][1]), (None, passages[5] + "x"), (-5, passages[5]), (600, None), (601, ""), (602, "a" * 49), (603, "a" * 50), (604, "a" * 500), (605, "ab" * 300), (605, "ab" * 300)]
    r.shuffle(rows)
    return rows


def frame(spark, rows, parts):
    return spark.createDataFrame([(i, t, "x", 1, b"y") for i, t in rows], "doc_id long, text string, c string, ids int, told binary").repartition(parts)


@pytest.mark.parametrize("seed", [1, 2])
def test_every_byte_as_by_all_windows(spark, seed):
    rows = library(seed)
    assert result(frame(spark, rows, 5)) == plain(rows, 50)


def test_long_texts_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rows = library(3, 60) + [(700, some_text(random.Random(9), 3000)), (699, some_text(random.Random(9), 2100)), (698, some_text(random.Random(9), 748))]
    assert result(frame(spark, rows, 3)) == plain(rows, 50)


def test_hot_grams_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "CHUNK", 2000)
    rows = library(4, 90)
    assert result(frame(spark, rows, 3)) == plain(rows, 50)


def test_other_widths(spark):
    r = random.Random(6)
    rows = [(i, some_text(r, r.choice([3, 30, 100]), "ab")) for i in range(60)]
    assert result(frame(spark, rows, 2), width=12, gram=5) == plain(rows, 12)


def test_no_rows(spark):
    assert result(frame(spark, [(1, "x")], 1).limit(0)) == []


def test_windows_are_dealt_whole():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 4, n, dtype=np.uint8) for n in (0, 49, 50, 51, 7, 400, 200_000)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    length, lead = window_owners(np.concatenate(texts), off, 50, 20)
    assert length.sum() == sum(max(0, len(t) - 49) for t in texts) and length.max() <= 31 and lead.max() <= 30


def test_covered():
    starts = np.zeros(20, dtype=bool)
    starts[[2, 4, 15]] = True
    assert np.flatnonzero(_covered(starts, 3)).tolist() == [2, 3, 4, 5, 6, 15, 16, 17]
    assert not _covered(np.zeros(2, bool), 3).any()
