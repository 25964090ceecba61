"""Byte-level BPE encoding and decoding, with tree concatenation of long texts.

Short texts are encoded in place. A long text is halved until its leaves are short; the
leaves are spread over tasks as rows of their own and encoded in parallel; then neighbours are
joined pairwise, as in a tree. At each join a window around the seam is encoded again
and grows until it agrees with both sides: it begins with the left side's token there and ends with
the right side's. Every adjacent pair of tokens has then been encoded together, and BPE
codes are exactly those sequences whose adjacent pairs are; so the result is the code of
the whole text, whether or not the text has a white space anywhere.

Defined cases: null text is empty and has no tokens; repeated rows each get a result; an
empty table gives no rows; control strings of the vocabulary count as the library counts
them; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import encoder, load, vocabulary_path

LEAF = 32_768
FIRST_WINDOW, AGREE = 16, 4


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id, by the byte-level alphabet of such vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}
    t = load(path)
    words = {i: w for w, i in t.get_vocab(with_added_tokens=True).items()}
    return [bytes(of[c] for c in words[i]) if i in words and all(c in of for c in words[i]) else words.get(i, "").encode() for i in range(max(words) + 1)]


def decode(ids: list[int], path: str) -> str:
    table_ = token_bytes(path)
    return b"".join(map(table_.__getitem__, ids)).decode("utf-8", "replace")


def _plain(text: str, path: str) -> list[int]:
    return load(path).encode(text, add_special_tokens=False).ids


def _starts_char(raw: bytes, at: int) -> bool:
    return at >= len(raw) or raw[at] & 0xC0 != 0x80


def join_codes(a: np.ndarray, b: np.ndarray, path: str) -> np.ndarray:
    """The code of a text from the codes of its two parts; the text around the seam comes from the tokens there."""
    if not len(a) or not len(b):
        return np.concatenate([a, b])
    of = token_bytes(path)
    width = FIRST_WINDOW
    while True:
        # w tokens back from the seam, on a character's edge; likewise forward
        i, j = max(0, len(a) - width), min(len(b), width)
        while i > 0 and not _starts_char(of[a[i]], 0):
            i -= 1
        while j < len(b) and not _starts_char(of[b[j]], 0):
            j += 1
        raw = b"".join(of[t] for part in (a[i:], b[:j]) for t in part.tolist())
        mid = np.asarray(_plain(raw.decode(), path), "<u4")
        whole_left, whole_right = i == 0, j == len(b)
        same_left = whole_left or np.array_equal(mid[:AGREE], a[i : i + AGREE])
        same_right = whole_right or np.array_equal(mid[-AGREE:], b[j - AGREE : j])
        if same_left and same_right and (len(mid) >= 2 * AGREE or whole_left and whole_right):
            return np.concatenate([a[:i], mid, b[j:]])
        width *= 4


def tree_join(parts: list[np.ndarray], path: str) -> np.ndarray:
    while len(parts) > 1:
        pairs = [join_codes(x, y, path) for x, y in zip(parts[::2], parts[1::2], strict=False)]
        parts = pairs + parts[len(parts) // 2 * 2 :]
    return parts[0] if parts else np.empty(0, "<u4")


def _digest(ids: list[int], path: str) -> tuple[int, str, str]:
    told = ",".join(map(str, ids))
    return len(ids), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(decode(ids, path).encode()).hexdigest()


def _ids(code: bytes) -> list[int]:
    return np.frombuffer(code, dtype="<u4").tolist()


def encode_documents(docs: DataFrame, path: str, leaf: int = LEAF, digest: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every row, or with ``digest`` (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else f"doc_id {kind}, ids array<int>"
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids"]

    def result(doc_ids, codes) -> pd.DataFrame:
        rows = [(d, *(_digest(c, path) if digest else (c,))) for d, c in zip(doc_ids, codes, strict=True)]
        return pd.DataFrame(rows, columns=["doc_id", *names])

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                some = b[at : at + 500]
                yield result(some["doc_id"], map(_ids, encoder(path, True).encode(some["text"])))

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(code=list(encoder(path, True).encode(b["text"])))

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        code = tree_join([np.frombuffer(c, dtype="<u4") for c in rows["code"]], path).tolist()
        times = int(rows["times"].iloc[0])
        return result([rows["doc_id"].iloc[0]] * times, [code] * times)

    n = F.char_length("text")
    done = docs.where(n <= leaf).mapInPandas(short, out)
    # equal long rows are encoded once
    long = docs.where(n > leaf).withColumn("of", F.sha2("text", 256)).groupBy("doc_id", "of").agg(F.first("text").alias("text"), F.count("*").alias("times"))
    # halving down to leaves of equal length
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.char_length("text") / leaf))).cast("int")
    long = long.withColumn("step", F.ceil(F.char_length("text") / parts).cast("int"))
    long = long.withColumn("n", F.explode(F.sequence(F.lit(0), F.ceil(F.char_length("text") / F.col("step")).cast("int") - 1)))
    long = long.select("doc_id", "of", "times", "n", F.substr("text", F.col("n") * F.col("step") + 1, F.col("step")).alias("text"))
    long = long.repartition("doc_id", "of", "n").mapInPandas(leaves, f"doc_id {kind}, of string, times long, n int, code binary")
    return done.unionByName(long.groupBy("doc_id", "of").applyInPandas(joined, out))


def decode_documents(codes: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, text)."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else decode(list(x), path))

    return codes.select("doc_id", text("ids").alias("text"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), digest=True)
