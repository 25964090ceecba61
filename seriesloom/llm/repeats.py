"""Suffix-array dedup: shards' Burrows-Wheeler transforms merged by interleave refinement.

Removed is each byte covered by a ``width``-byte string that also starts in a document with a smaller doc_id.

*Where strings can meet.* Each window of ``width`` bytes belongs to the gram (``gram`` bytes) of
the least hash in it. Equal windows have equal grams at equal places, so suffixes need ordering only
among those aligned at one gram. Documents are written once as chunks of bounded bytes; each chunk asks
the buckets of its grams' hashes which of them other documents hold too, and gets a bit for
each back. What is aligned at the others can't repeat.

*Shards.* A chunk is a shard. Its distinct contexts of shared grams (all windows that belong to the gram, other
bytes blank) are a collection of aligned strings, and their Burrows-Wheeler transform falls into columns: the bytes that
precede, in the order of the suffixes that begin one column further right. A shard sends a bucket's columns, names of grams and
the smallest doc_id of each context.

*Merge.* A bucket's shards are merged by refining an interleave, the merged order as shard numbers. From the last
column on, each refinement takes the next byte of every shard's transform in the order of the interleave
and deals its entries stably by that byte, inside their gram: the order one column further left. No suffix
is compared or sorted anew. The common prefix of neighbours is one more than the least common prefix between
them one column earlier, and 0 if their bytes differ; where it reaches ``width``, neighbours are one repeated interval, whose
smallest doc_id is the answer for all its windows. Answers go back to the chunks as runs.

*Sizes.* A very frequent gram with ever new surroundings (``hot``) is split: each of its windows
is dealt by its own bytes. A document beyond a chunk's size is several chunks that overlap by ``width - 1`` bytes and
are put together in the end. A shard names each distinct gram and context once, however many documents
hold it.

Defined cases: null text is empty and has nothing removed; texts shorter than ``width`` are kept; a null doc_id comes before
all others; rows that share a doc_id never remove from each other, whatever their texts; a doc_id is a whole
number; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import need_whole_ids, staged, table
from .shingles import mix

U = np.uint64
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: Bytes of a chunk's texts; bytes of text for which there is a bucket; documents from which a gram counts as hot.
CHUNK, BUCKET, HOT = 2 << 20, 16 << 20, 1 << 16
#: Bytes hashed at once, so that they stay in the processor's cache.
SLICE = 1 << 16
BLANK = 0xFF
SPANS = "array<struct<start: bigint, end: bigint>>"
OUT = f"doc_id bigint, n_bytes bigint, spans {SPANS}, kept binary"


def packed(*parts: np.ndarray) -> bytes:
    """Arrays as one compressed run of bytes."""
    raw = np.array([x.nbytes for x in parts], dtype=np.int64).tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), codec="zstd")
    sizes = np.frombuffer(raw, dtype=np.int64, count=len(kinds))
    ends = 8 * len(kinds) + np.cumsum(sizes)
    return [np.frombuffer(raw, dtype=k, count=n // np.dtype(k).itemsize, offset=e - n) for k, n, e in zip(kinds, sizes.tolist(), ends.tolist(), strict=True)]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array, and where each text begins (and the last ends)."""
    off = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """A 32-bit hash of every run of ``size`` bytes, by doubling."""
    u = np.uint32
    power, width, out, covered = x.astype(u), 1, None, 0
    while True:
        if size & width:
            out = power if out is None else out[: len(power) - covered] * u(0x165667B1) + power[covered:]
            covered += width
        if 2 * width > size:
            break
        power = power[:-width] * u(0x9E3779B1) + power[width:]
        power ^= power >> u(15)
        width *= 2
    out = out[: len(x) - size + 1] * u(0x85EBCA77)
    out ^= out >> u(13)
    out *= u(0xC2B2AE3D)
    return out ^ (out >> u(16))


def window_owners(raw: np.ndarray, off: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts in order, as runs that belong to one gram: lengths, and how far behind a run's
    first window its gram begins."""
    if len(raw) < width:
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    owner = np.empty(len(raw) - width + 1, dtype=np.int32)
    for a in range(0, len(owner), SLICE):
        h = gram_hashes(raw[a : a + SLICE + width - 1], gram)
        m, n, over = (h.astype(U) << U(32)) | np.arange(len(h), dtype=U), 1, width - gram + 1
        while 2 * n <= over:
            m, n = np.minimum(m[:-n], m[n:]), 2 * n
        if over > n:
            m = np.minimum(m[: n - over], m[over - n :])
        owner[a : a + len(m)] = (m & U(0xFFFFFFFF)).astype(np.int32) + a
    long_ = np.flatnonzero(np.diff(off) >= width)
    edge = np.zeros(len(raw) + 1, dtype=np.int8)
    edge[off[long_]] += 1
    edge[off[long_ + 1] - width + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    owner = owner[at]
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]))
    return np.diff(np.append(first, len(at))).astype(np.uint8), (owner[first] - at[first]).astype(np.uint8)


def _names(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte rows."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    words[:, : rows.shape[1]] = rows
    words, h = words.view(U), np.zeros(len(rows), dtype=U)
    for i in range(words.shape[1]):
        h = mix(h * U(0xD6E8FEB86659FD93) + words[:, i] + U(0x9E3779B97F4A7C15))
    return h


def _order(*keys: np.ndarray) -> np.ndarray:
    """Stable order by a few small numbers (of 23 and 8 bits together at most), by one sort."""
    n = len(keys[0])
    key = np.zeros(n, dtype=U)
    for k in keys:
        key = (key << U(8)) | k.astype(U)
    return (np.sort((key << U(32)) | np.arange(n, dtype=U)) & U(0xFFFFFFFF)).astype(np.int64)


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def _firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


class Chunk:
    """Some texts with the runs of their windows and the buckets and names of the runs' grams."""

    def __init__(self, body: bytes, width: int, gram: int, bits: int):
        self.width, self.gram = width, gram
        self.ids, sizes, length, lead, self.raw = unpacked(body, np.int64, np.int64, np.uint8, np.uint8, np.uint8)
        self.off = np.concatenate([[0], np.cumsum(sizes)])
        self.length, self.lead = length.astype(np.int64), lead.astype(np.int64)
        windows = np.concatenate([[0], np.cumsum(np.maximum(np.diff(self.off) - width + 1, 0))])
        nth = np.cumsum(self.length) - self.length
        self.doc = np.searchsorted(windows, nth, side="right") - 1
        self.start = nth - windows[self.doc] + self.off[self.doc]
        h = np.zeros(0, dtype=U)
        if len(self.start):
            h = _names(np.lib.stride_tricks.sliding_window_view(self.raw, gram)[self.start + self.lead])
        # bucket and name: 32 bits of each
        self.key = ((h >> U(64 - bits)) << U(32)) | (h & U(0xFFFFFFFF))
        self.bits = bits

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and in how many documents each is (255 at most)."""
        order = np.lexsort((self.doc, self.key))
        key, doc = self.key[order], self.doc[order]
        pair = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.zeros(0, bool)
        first = _firsts(key)
        docs = np.add.reduceat(pair, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        return key[first], np.minimum(docs, 255).astype(np.uint8)

    def contexts(self, told: list[dict]) -> Contexts:
        keys, _ = self.grams()
        shared, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for t in told:
            a, b = np.searchsorted(keys, np.array([t["b"], t["b"] + 1], dtype=U) << U(32))
            shared[a:b] = np.unpackbits(np.frombuffer(t["shared"], dtype=np.uint8), count=b - a)
            hot[a + np.frombuffer(t["hot"], dtype=np.int32)] = True
        mine = np.searchsorted(keys, self.key)
        return Contexts(self, shared[mine] & ~hot[mine], hot[mine])


class Contexts:
    """The distinct contexts of a chunk's shared grams, by bucket and name, and who holds each."""

    def __init__(self, chunk: Chunk, shared: np.ndarray, hot: np.ndarray):
        width, left = chunk.width, chunk.width - chunk.gram
        columns = width + left
        once = np.flatnonzero(hot)
        each = _spread(np.zeros(len(once), np.int64), chunk.length[once])  # a hot gram's windows, one by one
        once = np.repeat(once, chunk.length[once])
        some = np.flatnonzero(shared)
        self.start = np.concatenate([chunk.start[some], chunk.start[once] + each])
        self.length = np.concatenate([chunk.length[some], np.ones(len(once), np.int64)])
        lead = np.concatenate([chunk.lead[some], chunk.lead[once] - each])
        self.doc = np.concatenate([chunk.doc[some], chunk.doc[once]])
        key = np.concatenate([chunk.key[some], np.zeros(len(once), U)])
        n = len(self.start)
        rows = np.full((n, columns + 2), BLANK, dtype=np.uint8)
        wide = np.concatenate([np.zeros(left, np.uint8), chunk.raw, np.zeros(columns, np.uint8)])
        if n:
            rows[:, :columns] = np.lib.stride_tricks.sliding_window_view(wide, columns)[self.start + lead]
        place = np.arange(columns)
        rows[:, :columns][(place < (left - lead)[:, None]) | (place >= (left - lead + self.length + width - 1)[:, None])] = BLANK
        rows[:, columns], rows[:, columns + 1] = lead, self.length
        name = _names(rows)
        key[len(some) :] = ((name[len(some) :] >> U(64 - chunk.bits)) << U(32)) | (name[len(some) :] & U(0xFFFFFFFF))
        order = np.lexsort((name, key))
        first = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (key[order][1:] != key[order][:-1])]) if n else np.zeros(0, bool)
        # hashes only propose: rows that differ from the one before are others
        again = np.flatnonzero(~first)
        first[again[(rows[order[again]] != rows[order[again - 1]]).any(axis=1)]] = True
        at = np.flatnonzero(first)
        self.which = np.empty(n, np.int64)
        self.which[order] = np.cumsum(first) - 1
        self.rows, self.key = rows[order[at]], key[order[at]]
        self.least = np.minimum.reduceat(chunk.ids[self.doc][order], at) if n else np.zeros(0, np.int64)
        self.columns = columns
        self.cells = self.rows[:, columns + 1].astype(np.int64)

    def buckets(self) -> Iterator[tuple[int, int, int]]:
        """(bucket, first context, last context exclusive)"""
        b = (self.key >> U(32)).astype(np.int64)
        first = _firsts(b)
        yield from zip(b[first].tolist(), first.tolist(), [*first[1:].tolist(), len(b)], strict=True)

    def transform(self) -> np.ndarray:
        """The preceding bytes of each column's sorted suffixes, inside each gram."""
        n = len(self.key)
        bwt, item = np.empty((self.columns, n), dtype=np.uint8), np.arange(n)
        group = np.cumsum(np.concatenate([[0], self.key[1:] != self.key[:-1]])) if n else np.zeros(0, np.int64)
        by_column = np.ascontiguousarray(self.rows[:, : self.columns].T)
        for j in range(self.columns - 1, -1, -1):
            bwt[j] = by_column[j][item]
            item = item[_order(group, bwt[j])]
        return bwt


def merged(shards: list[dict], width: int, gram: int) -> list[np.ndarray]:
    """For each shard the smallest doc_id of every window of its contexts, in order."""
    left = width - gram
    columns = width + left
    sizes = np.array([len(s["names"]) for s in shards])
    bwt = np.concatenate([s["bwt"].reshape(columns, -1) for s in shards], axis=1)
    names, least = np.concatenate([s["names"] for s in shards]), np.concatenate([s["least"] for s in shards])
    lead, length = np.concatenate([s["lead"] for s in shards]).astype(np.int64), np.concatenate([s["length"] for s in shards]).astype(np.int64)
    shard = np.repeat(np.arange(len(shards)), sizes)
    item = np.argsort(names, kind="stable")
    group = np.cumsum(np.concatenate([[0], names[item][1:] != names[item][:-1]]))
    head = np.concatenate([[True], group[1:] != group[:-1]])
    rank, common, n = item.copy(), np.zeros(len(item) + 1, dtype=np.int32), len(item)
    answer = np.full((n, left + 1), HIGHEST, dtype=np.int64)
    for j in range(columns - 1, -1, -1):
        byte = bwt[j][rank]
        order = _order(group, byte)
        # neighbours by the same byte: one more than the least common prefix between them
        same = np.concatenate([[False], ~head[1:] & (byte[order[1:]] == byte[order[:-1]])])
        after = np.zeros(n + 1, dtype=np.int32)
        at = np.flatnonzero(same)
        before, now = order[at - 1], order[at]
        after[at] = common[now] + 1
        apart = np.flatnonzero(now != before + 1)
        if len(apart):
            ends = np.stack([before[apart] + 1, now[apart] + 1], axis=1).reshape(-1)
            after[at[apart]] = np.minimum.reduceat(common, ends)[::2] + 1
        common, item = after, item[order]
        # an entry's rank in its shard: its place among that shard's entries of the interleave
        rank = np.empty(n, dtype=np.int64)
        rank[np.argsort(shard[item].astype(np.uint16), kind="stable") if len(shards) < 1 << 16 else np.argsort(shard[item], kind="stable")] = np.arange(n)
        if j <= left:
            own = (j >= left - lead[item]) & (j < left - lead[item] + length[item])
            first = np.flatnonzero(common[:n] < width)
            best = np.minimum.reduceat(np.where(own, least[item], HIGHEST), first)
            answer[item, j] = np.repeat(best, np.diff(np.append(first, n)))
    place = np.arange(left + 1)
    own = (place >= (left - lead)[:, None]) & (place < (left - lead + length)[:, None])
    return [answer[a:b][own[a:b]] for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True)]


def write_chunks(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Texts in chunks, with the runs of their windows, written once."""
    schema = "c bigint, doc bigint, at bigint, whole boolean, size bigint, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def row(ids: pa.Array, texts: pa.Array, doc: int, at: int, whole: bool) -> pa.RecordBatch:
            nonlocal number
            raw, off = bytes_of(texts)
            body = packed(ids.to_numpy(), np.diff(off), *window_owners(raw, off, width, gram), raw)
            columns = [*[pa.array([x], pa.int64()) for x in (number, doc, at)], pa.array([whole]), pa.array([len(raw)], pa.int64()), pa.array([body], pa.binary())]
            number += 1
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

        held: list[tuple[pa.Array, pa.Array]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                yield row(pa.concat_arrays([i for i, _ in held]), pa.concat_arrays([t for _, t in held]), number, 0, True)
            held, size = [], 0

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n = np.diff(bytes_of(texts)[1])
            first = 0
            for i in range(len(n)):
                if n[i] > CHUNK:
                    if i > first:
                        held.append((ids.slice(first, i - first), texts.slice(first, i - first)))
                    yield from flush()
                    first, text, doc = i + 1, texts[i].as_buffer().to_pybytes(), number
                    for at in range(0, len(text) - width + 1, CHUNK):
                        yield row(ids.slice(i, 1), pa.array([text[at : at + CHUNK + width - 1]], pa.binary()), doc, at, False)
                    continue
                size += int(n[i])
                if size >= CHUNK:
                    held.append((ids.slice(first, i + 1 - first), texts.slice(first, i + 1 - first)))
                    first = i + 1
                    yield from flush()
            if first < len(n):
                held.append((ids.slice(first), texts.slice(first)))
        yield from flush()

    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return staged(d.mapInArrow(run, schema), "chunks")


def _joined(chunks: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """Chunks with what is known of each. It grows with the texts, so both sides are shuffled at every size."""
    return chunks.join(few.hint("merge"), "c", how)


def _rows(batches: Iterator[pa.RecordBatch], width: int, gram: int, bits: int) -> Iterator[tuple[pa.RecordBatch, int, Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i, Chunk(batch.column("body")[i].as_py(), width, gram, bits)


def shared_grams(chunks: DataFrame, width: int, gram: int, bits: int) -> DataFrame:
    """(c, told): which grams of each chunk other documents hold too, bucket by bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, chunk in _rows(batches, width, gram, bits):
            keys, docs = chunk.grams()
            bucket = (keys >> U(32)).astype(np.int64)
            first = _firsts(bucket)
            ends = [*first[1:].tolist(), len(keys)]
            names = (keys & U(0xFFFFFFFF)).astype(np.uint32)
            cut = list(zip(first.tolist(), ends, strict=True))
            c = batch.column("c")[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(cut), pa.int64()), pa.array(bucket[first]), pa.array([names[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([docs[a:b].tobytes() for a, b in cut], pa.binary())],
                names=["c", "b", "names", "docs"],
            )

    def tell(asked: pa.Table) -> pa.Table:
        names = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in asked.column("names")]
        docs = np.frombuffer(b"".join(x.as_py() for x in asked.column("docs")), dtype=np.uint8)
        sizes = np.array([len(x) for x in names])
        every = np.concatenate(names)
        order = np.argsort(every, kind="stable")
        first = _firsts(every[order])
        held = np.add.reduceat(docs[order].astype(np.int64), first)
        held = np.repeat(held, np.diff(np.append(first, len(every))))
        total = np.empty_like(held)
        total[order] = held
        shared, hot, at = [], [], np.cumsum(sizes) - sizes
        for a, n in zip(at.tolist(), sizes.tolist(), strict=True):
            mine = total[a : a + n]
            shared.append(np.packbits(mine > 1).tobytes())
            hot.append(np.flatnonzero(mine > HOT).astype(np.int32).tobytes())
        return pa.table({"c": asked.column("c"), "b": asked.column("b"), "shared": pa.array(shared, pa.binary()), "hot": pa.array(hot, pa.binary())})

    asked = chunks.select("c", "body").mapInArrow(ask, "c bigint, b bigint, names binary, docs binary")
    told = asked.groupBy("b").applyInArrow(tell, "c bigint, b bigint, shared binary, hot binary")
    return staged(told.groupBy("c").agg(F.collect_list(F.struct("b", "shared", "hot")).alias("told")), "shared")


def repeated_windows(chunks: DataFrame, told: DataFrame, width: int, gram: int, bits: int) -> DataFrame:
    """(c, answers): smallest doc_ids of the windows of each chunk's contexts, as runs, bucket by bucket."""
    columns = 2 * width - gram

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, chunk in _rows(batches, width, gram, bits):
            x = chunk.contexts(batch.column("told")[i].as_py())
            bwt, c = x.transform(), batch.column("c")[i].as_py()
            names = (x.key & U(0xFFFFFFFF)).astype(np.uint32)
            cut = list(x.buckets())
            sent = [packed(names[a:b], x.least[a:b], x.rows[a:b, columns], x.rows[a:b, columns + 1], bwt[:, a:b]) for _, a, b in cut]
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(cut), pa.int64()), pa.array([b for b, _, _ in cut], pa.int64()), pa.array(sent, pa.binary())], names=["c", "b", "shard"])

    def merge(sent: pa.Table) -> pa.Table:
        keys = ("names", "least", "lead", "length", "bwt")
        shards = [dict(zip(keys, unpacked(x.as_py(), np.uint32, np.int64, np.uint8, np.uint8, np.uint8), strict=True)) for x in sent.column("shard")]
        answers = []
        for own in merged(shards, width, gram):
            first = _firsts(own)
            answers.append(packed(own[first], np.diff(np.append(first, len(own))).astype(np.uint32)))
        return pa.table({"c": sent.column("c"), "b": sent.column("b"), "answer": pa.array(answers, pa.binary())})

    sent = _joined(chunks.select("c", "body"), told, "inner").mapInArrow(send, "c bigint, b bigint, shard binary")
    back = sent.groupBy("b").applyInArrow(merge, "c bigint, b bigint, answer binary")
    return staged(back.groupBy("c").agg(F.collect_list(F.struct("b", "answer")).alias("answers")), "answers")


def _removed(chunk: Chunk, told: list[dict] | None, answers: list[dict] | None) -> np.ndarray:
    """Whether a window that is to go begins at each byte."""
    starts = np.zeros(len(chunk.raw), dtype=bool)
    if not told:
        return starts
    x = chunk.contexts(told)
    ends = np.cumsum(x.cells)
    begin = ends - x.cells
    least = np.full(ends[-1] if len(ends) else 0, HIGHEST, dtype=np.int64)
    by_bucket = {t["b"]: t for t in answers or []}
    for b, first, last in x.buckets():
        t = by_bucket[b]
        least[begin[first] : ends[last - 1]] = np.repeat(*unpacked(t["answer"], np.int64, np.uint32))
    cell, place = _spread(begin[x.which], x.length), _spread(x.start, x.length)
    starts[place[least[cell] < np.repeat(chunk.ids[x.doc], x.length)]] = True
    return starts


def _covered(starts: np.ndarray, width: int) -> np.ndarray:
    upto = np.cumsum(starts, dtype=np.int64)
    return upto - np.concatenate([np.zeros(min(width, len(upto)), np.int64), upto[:-width]]) > 0


def _told(ids: np.ndarray, raw: np.ndarray, off: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    """What stays of each text, and the runs that go."""
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    before, after = np.concatenate([[False], gone]), np.concatenate([gone, [False]])
    first, last = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    doc = np.searchsorted(off, first, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array(first - off[doc]), pa.array(last - off[doc])], names=["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, off).astype(np.int32)), spans)
    stays = np.concatenate([[0], np.cumsum(~gone)])[off].astype(np.int32)
    kept = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(stays), pa.py_buffer(np.ascontiguousarray(raw[~gone]))])
    return pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == LOWEST), pa.array(np.diff(off)), lists, kept], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = 20) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, spans, kept): a row for each, spans in bytes, kept the bytes that stay."""
    need_whole_ids(docs)
    ship(docs.sparkSession)
    chunks = write_chunks(docs, width, gram)
    bits = max(4, (int(chunks.agg(F.sum("size")).first()[0] or 0) // BUCKET).bit_length())
    told = shared_grams(chunks, width, gram, bits)
    answers = repeated_windows(chunks, told, width, gram, bits)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, chunk in _rows(batches, width, gram, bits):
            starts = _removed(chunk, batch.column("told")[i].as_py(), batch.column("answers")[i].as_py())
            # windows end inside their texts
            yield _told(chunk.ids, chunk.raw, chunk.off, _covered(starts, width))

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, chunk in _rows(batches, width, gram, bits):
            starts = _removed(chunk, batch.column("told")[i].as_py(), batch.column("answers")[i].as_py())
            row = [batch.column(c).slice(i, 1) for c in ("doc", "at")] + [pa.array(chunk.ids[:1]), pa.array([chunk.raw.tobytes()], pa.binary()), pa.array([np.packbits(starts).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, names=["doc", "at", "id", "raw", "starts"])

    def joined(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("at")
        at = pieces.column("at").to_numpy()
        parts = [np.frombuffer(x.as_py(), dtype=np.uint8) for x in pieces.column("raw")]
        raw = np.concatenate([*[p[: b - a] for p, a, b in zip(parts, at[:-1], at[1:], strict=False)], parts[-1]])
        starts = np.zeros(len(raw), dtype=bool)
        for a, p, s in zip(at, parts, pieces.column("starts"), strict=True):
            starts[a : a + len(p)] |= np.unpackbits(np.frombuffer(s.as_py(), dtype=np.uint8), count=len(p)).astype(bool)
        return pa.Table.from_batches([_told(pieces.column("id").to_numpy()[:1], raw, np.array([0, len(raw)]), _covered(starts, width))])

    full = _joined(_joined(chunks, told, "left"), answers, "left")
    whole = full.where("whole").select("body", "told", "answers").mapInArrow(finish, OUT)
    # of a text beyond a chunk, as a group its own pieces
    long_ = full.where("not whole").select("doc", "at", "body", "told", "answers").mapInArrow(piece, "doc bigint, at bigint, id bigint, raw binary, starts binary").groupBy("doc").applyInArrow(joined, OUT)
    return whole.unionByName(long_)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and runs of every document, and the digest of what stays."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", gone.cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
