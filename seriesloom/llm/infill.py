"""Fill-in-middle transformation over code points, cut by succinct rank and select.

The bytes of a batch of texts, one Arrow buffer, are marked by a packed bitvector: a bit for each
byte, set where a code point begins. A directory holds the popcount in front of each block of 512
bits. The popcount of a text's stretch is its number n of code points; a select of two
ranks gives the bytes at which its middle begins and ends, so no text is decoded and no offset
is kept for each code point. Spark then takes the three parts out of the text's bytes.

Cuts and form come from the sha256 of ``salt:doc_id``. A transformed text is
psm (prefix, suffix, middle) or spm (suffix, prefix, middle) with a mark in front of each part; a text
that is empty or holds a mark already stays plain, as does a share of the others, so
that ``restored`` always gives back the exact text.

Defined cases: null text is empty; a null doc_id is hashed as the word null; rows that share a doc_id
draw the same hashes and are cut by their own lengths; texts of any length are marked in slices of bounded size,
an eighth of their bytes and a number for each block are held; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a block, of which the bits make eight words; bytes that are marked at once.
BLOCK, SLICE = 512, 1 << 20
CUTS = "struct<n: bigint, prefix_chars: bigint, middle_chars: bigint, from_byte: bigint, to_byte: bigint>"


class Boundaries:
    """A bit for each byte of UTF-8, set where a code point begins, with a popcount directory."""

    def __init__(self, raw: np.ndarray):
        words = -(-len(raw) // BLOCK) * BLOCK // 8
        self.bits = np.zeros(words + BLOCK // 8, dtype=np.uint8)  # one empty block ends them
        for a in range(0, len(raw), SLICE):
            part = np.packbits((raw[a : a + SLICE] & 0xC0) != 0x80)
            self.bits[a // 8 : a // 8 + len(part)] = part
        blocks = np.bitwise_count(self.bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(blocks)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that begin before each byte."""
        block, rest = at // BLOCK, at % BLOCK
        inside = self.bits.reshape(-1, BLOCK // 8)[block]
        whole = np.bitwise_count(inside) * (np.arange(BLOCK // 8) < (rest // 8)[:, None])
        last = inside[np.arange(len(at)), rest // 8] >> (8 - rest % 8).astype(np.uint8)
        return self.before[block] + whole.sum(axis=1, dtype=np.int64) + np.bitwise_count(last)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The byte at which the code point of each rank (from 0) begins; each must exist."""
        block = np.searchsorted(self.before, rank, side="right") - 1
        inside = self.bits.reshape(-1, BLOCK // 8)[block]
        upto = np.cumsum(np.bitwise_count(inside), axis=1, dtype=np.int64)
        rest = rank - self.before[block]
        byte = (upto <= rest[:, None]).sum(axis=1)
        row = np.arange(len(rank))
        rest = rest - np.where(byte > 0, upto[row, np.maximum(byte, 1) - 1], 0)
        bits = np.cumsum(np.unpackbits(inside[row, byte][:, None], axis=1), axis=1)
        return block * BLOCK + byte * 8 + (bits <= rest[:, None]).sum(axis=1)


def cut_points(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.StructArray:
    """For each text: its code points, the lengths of prefix and middle, and the middle's first and last byte (exclusive)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    marks = Boundaries(raw)
    ranks = marks.rank(offsets)
    n = np.diff(ranks)
    a, b = first % (n + 1), second % (n + 1)
    a, b = np.minimum(a, b), np.maximum(a, b)

    def byte(chars: np.ndarray) -> np.ndarray:
        out = offsets[1:] - offsets[:-1]
        inner = chars < n  # a cut behind the last code point is the text's end
        out[inner] = marks.select((ranks[:-1] + chars)[inner]) - offsets[:-1][inner]
        return out

    return pa.StructArray.from_arrays([pa.array(x) for x in (n, a, b - a, byte(a), byte(b))], names=["n", "prefix_chars", "middle_chars", "from_byte", "to_byte"])


def _draw(doc_id: Column, salt: str, i: int) -> Column:
    """The i-th 8-digit group of the hash, an unsigned integer."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, salt: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """(doc_id, text) to (doc_id, n, form, prefix_chars, middle_chars, text, output).

    ``plain`` percent of the texts stay as they are; of the others ``spm`` percent are spm."""

    @F.arrow_udf(CUTS)
    def cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        return cut_points(text, first.to_numpy(), second.to_numpy())

    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"), *[_draw(F.col("doc_id"), salt, i).alias(f"h{i}") for i in range(4)])
    d = d.withColumn("cut", cuts("text", "h0", "h1"))
    held = F.col("text").contains(MARKS[0]) | F.col("text").contains(MARKS[1]) | F.col("text").contains(MARKS[2])
    form = F.when((F.col("text") == "") | held | (F.col("h2") % 100 >= 100 - plain), "plain").when(F.col("h3") % 100 < spm, "spm").otherwise("psm")
    d = d.select("doc_id", "text", "cut.*", form.alias("form"))
    raw, a, b = F.col("text").cast("binary"), F.col("from_byte").cast("int"), F.col("to_byte").cast("int")
    piece = lambda start, length: F.substring(raw, start + 1, length).cast("string")
    p, m, s = piece(F.lit(0), a), piece(a, b - a), piece(b, F.octet_length("text") - b)
    mark = dict(zip("PSM", map(F.lit, MARKS), strict=True))
    output = (
        F.when(F.col("form") == "psm", F.concat(mark["P"], p, mark["S"], s, mark["M"], m))
        .when(F.col("form") == "spm", F.concat(mark["S"], s, mark["P"], p, mark["M"], m))
        .otherwise(F.col("text"))
    )
    chars = [F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix_chars", "middle_chars")]
    return d.select("doc_id", "n", "form", *chars, "text", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from which ``fill_in_middle`` made ``output``."""
    parts = F.split(output, "|".join(MARKS), -1)  # in front of the first mark there is nothing
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every text's transformation and of what is restored from it."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


OP11_SQL = r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x FROM documents),
u AS (SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256 FROM p"""
