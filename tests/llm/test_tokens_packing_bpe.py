from __future__ import annotations

import hashlib
import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest

from seriesloom.llm.bpe import decode_documents, encode_documents
from seriesloom.llm.packing import pack_documents, placements
from seriesloom.llm.tokens import Cached, load, spaced_words_of, vocabulary_path, words_of

ODD = ["Ünïcode Ωmega ΣΑΣ. İstanbul, Straße. DON'T can't, x.y a,, b.. it's,", "日本語, テスト. ﬁ. 12,3 4. .. , . ,", " ", "", None, "\t\n x,\n", "<|endoftext|> a  b\n\n c", "ab" * 30_000, "x " * 40_000]


def texts() -> list[str | None]:
    r = random.Random(1)
    return ODD + [" ".join("".join(r.choice("aeinrst") for _ in range(r.randrange(1, 9))) + r.choice(["", "", ",", "."]) for _ in range(r.randrange(1, 900))) for _ in range(60)]


def test_packing_is_whole_and_dense(spark):
    path = vocabulary_path("word_bpe_49k.json")
    rows = list(enumerate(texts()))
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    pieces: dict[int, list] = {}
    for p in sorted(got, key=lambda p: (p.doc_id, p.piece)):
        pieces.setdefault(p.doc_id, []).append(p)
    total = 0
    for d, t in rows:
        ids = np.array([*load(path).encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        want = [(n, at, len(part), zlib.crc32(part.tobytes())) for n, at in enumerate(range(0, len(ids), 2048)) if len(part := ids[at : at + 2048])]
        assert [(p.piece, p.start, p.length, p.ids_crc32) for p in pieces[d]] == want
    rooms: dict[int, list] = {}
    for p in got:
        rooms.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for held in rooms.values():
        held.sort()
        assert [a for a, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= 2048
    assert len(rooms) <= -(-total // 2048) + 2


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    gaps: list[int] = []  # sorted
    opened = 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(gaps, n)
        if at == len(gaps):
            opened += 1
            gap = capacity
        else:
            gap = gaps.pop(at)
        insort(gaps, gap - n)
    return opened


def made_up(n: int, seed: int, mean: float, spread: float) -> list[int]:
    r = random.Random(seed)
    return [min(2048, int(r.lognormvariate(mean, spread)) + 1) for _ in range(n)]


@pytest.mark.parametrize(("lengths", "stripes"), [(made_up(20_000, 1, 6.2, 0.8), 1), (made_up(3000, 2, 6.8, 0.4), 1), (made_up(20_000, 3, 5.5, 1.0), 3), ([2048] * 5 + [1] * 9, 2), ([], 1)])
def test_sweeps_place_every_piece_as_well_as_best_fit_decreasing(spark, lengths, stripes):
    counts = list(Counter(lengths).items())
    plan = placements(spark.createDataFrame(counts, "size long, n long"), 2048, stripes).collect()
    ranks: dict[int, list] = {}
    rooms: dict[int, list] = {}
    for p in plan:
        ranks.setdefault(p.length, []).append((p["from"], p.to))
        for i in range(p.to - p["from"]):
            rooms.setdefault(p.sequence + i // p.each, []).append((p.offset + i % p.each * p.length, p.length))
    for n, c in counts:
        spans = sorted(ranks[n])
        assert spans[0][0] == 0 and spans[-1][1] == c and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    for held in rooms.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and sum(held[-1]) <= 2048
    best = best_fit_decreasing(lengths, 2048)
    assert len(rooms) == best if stripes == 1 else len(rooms) <= best + stripes * 12


def test_packing_of_repeated_rows_clashing_columns_and_no_rows(spark):
    path = vocabulary_path("word_bpe_49k.json")
    schema = "doc_id long, text string, length string, sequence_id string, from string, __salt string"
    rows = [(1, "a b", "x", "x", "x", "x")] * 3 + [(None, None, "x", "x", "x", "x"), (2, "", "x", "x", "x", "x")]
    got = pack_documents(spark.createDataFrame(rows, schema), path).collect()
    assert sorted((p.doc_id or 0, p.length) for p in got) == [(0, 1), (1, 3), (1, 3), (1, 3), (2, 1)]
    assert len({p.offset for p in got}) == 5 and len({p.sequence_id for p in got}) == 1
    assert pack_documents(spark.createDataFrame([], schema), path).collect() == []


def test_bpe_equals_the_library(spark):
    path = vocabulary_path("byte_bpe_50k.json")
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in encode_documents(df, path, leaf=1000, digest=True).collect()}
    for d, t in rows:
        ids = load(path).encode(t or "", add_special_tokens=False).ids
        back = load(path).decode(ids, skip_special_tokens=False)
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), d
        assert got[d].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest(), d


def test_cached_encoding_equals_the_library():
    r = random.Random(5)
    odd = [*"abcXYZ ,.'-\n\t0123İक़יִ́ͅßΣéﬁ日한하‍  \0\x1c\x85", "\U0001f600", "ǅ", "ŉ", "ẞ", "<|endoftext|>", "'S", "'re", "क़", "יִ"]
    some = ["İ,", "aİ, b", "क़, x", "יִ.", *("".join(r.choice(odd) for _ in range(r.randrange(1, 25))) for _ in range(4000))]
    for name, chunks in (("word_bpe_49k.json", words_of), ("byte_bpe_50k.json", spaced_words_of)):
        path = vocabulary_path(name)
        got = [np.frombuffer(x, dtype="<u4").tolist() for x in Cached(path, chunks).encode(some)]
        for text, ids in zip(some, got, strict=True):
            assert ids == load(path).encode(text, add_special_tokens=False).ids, ascii(text)


def test_bpe_of_repeated_rows_clashing_columns_and_no_rows(spark):
    path = vocabulary_path("byte_bpe_50k.json")
    schema = "doc_id long, text string, n string, of string, times string, code string"
    long = "word " * 900
    rows = [(1, long), (1, long), (1, long + "x"), (None, None), (None, long), (2, ""), (2, "a"), (2, "a")]
    got = encode_documents(spark.createDataFrame([(*r, "n", "o", "t", "c") for r in rows], schema), path, leaf=1000).collect()
    want = [(str(d), load(path).encode(t or "", add_special_tokens=False).ids) for d, t in rows]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted(want)
    back = decode_documents(spark.createDataFrame(got, "doc_id long, ids array<int>"), path).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t in rows)
    assert encode_documents(spark.createDataFrame([], schema), path).collect() == []
