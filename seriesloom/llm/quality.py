"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on every text. The votes of a
text form one of 3**len(LABELLERS) patterns at most, so Spark counts patterns over all texts
and expectation-maximisation (two classes, a confusion table for each labeller) runs on
that bounded table: it estimates how far each labeller can be trusted and gives each pattern the
posterior chance of being good. With those posteriors as soft labels a logistic model over
hashed word shapes is fitted, on a sample of at most ``sample`` different texts (chosen by
hash, so repeatable); it then scores every text.

A feature is the share of a shape, or of a sign, among the words of the text, so a score is a mean over words and
means the same at every length; that the scorer knows short texts, a few windows of each
text of the sample are learned from too, with the text's own label.

Defined cases: null text is empty; a text without words holds nothing against it and is kept; repeated rows get equal scores; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import table
from .tokens import forget

SAMPLE, WIDTH, KEEP_FROM = 20_000, 4096, 0.3
#: Windows of a text in training, and how many words they may have.
WINDOWS, LENGTHS = 4, (2, 4, 6, 10, 17, 27, 43)
SYMBOLS = np.array([ord(c) for c in "#$%&*|<>{}[]\\^~_=@!"])
CAPITALS, SMALL = np.arange(65, 91), np.concatenate([np.arange(97, 123), np.arange(128, 256)])
SHAPE = bytes(ord("A") if 65 <= b < 91 else ord("a") if 97 <= b < 123 or b >= 128 else ord("9") if 48 <= b < 58 else b for b in range(256))
RUNS = re.compile(rb"(.)\1+")
LABELLERS = ("symbols", "capitals", "repeats", "variety", "bars", "sentences", "tails")


def votes(text: str) -> list[int]:
    """One of 0 (abstains), 1 (good), 2 (bad) for each of LABELLERS."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * len(LABELLERS)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    count = np.bincount(raw, minlength=256)
    letters = int(count[CAPITALS].sum() + count[SMALL].sum())
    symbols = int(count[SYMBOLS].sum()) / len(raw)
    capitals = int(count[CAPITALS].sum()) / max(letters, 1)
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    variety = len(set(words)) / n**0.5
    bars = int(count[124]) / n
    ends = sum(map(text.count, (". ", ".\n", "? ", "! "))) + text.rstrip().endswith((".", "?", "!"))
    tails = sum(not w[-1].isalnum() and w[-1] not in ".,;:?!)\"'" for w in words) / n
    judge = lambda bad, good: 2 if bad else 1 if good else 0
    return [
        judge(symbols > 0.03, symbols < 0.01),
        judge(capitals > 0.25, capitals < 0.12),
        judge(n >= 8 and repeats > 0.1, n >= 20 and repeats < 0.03),
        judge(n >= 40 and variety < 3, n >= 40 and variety > 5),
        judge(bars > 0.1, False),
        judge(n >= 60 and ends / n < 0.01, n >= 20 and 0.02 < ends / n < 0.3),
        judge(n >= 8 and tails > 0.15, n >= 20 and tails < 0.02),
    ]


def pattern_of(text: str) -> int:
    return sum(v * 3**i for i, v in enumerate(votes(text)))


def posteriors(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """The chance of being good of each vote pattern, by expectation-maximisation."""
    if not counts:
        return {}
    names = sorted(counts)
    k = len(LABELLERS)
    v = np.array([[p // 3**i % 3 for i in range(k)] for p in names])
    n = np.array([counts[p] for p in names], dtype=float)
    good, bad = (v == 1).sum(1), (v == 2).sum(1)
    # a labeller that objects is rarer and says more, so the start weighs it thrice
    q = (1 + good) / (2 + good + 3 * bad)
    for _ in range(rounds):
        w = np.stack([q * n, (1 - q) * n])
        prior = (w.sum(1) + 1) / (w.sum() + 2)
        table_ = np.stack([(np.stack([np.where(v == o, x[:, None], 0).sum(0) for o in range(3)]) + 1) / (x.sum() + 3) for x in w])  # class, vote, labeller
        like = np.log(prior)[:, None] + np.log(table_[:, v, np.arange(k)]).sum(2)
        q = 1 / (1 + np.exp(np.clip(like[1] - like[0], -500, 500)))
    # of the two classes the one with fewer objections is the good one
    if (q * n * bad).sum() / max((q * n).sum(), 1e-9) > ((1 - q) * n * bad).sum() / max(((1 - q) * n).sum(), 1e-9):
        q = 1 - q
    return dict(zip(names, q.tolist(), strict=True))


@lru_cache(maxsize=100_000)
def _known_slots(shape: bytes) -> tuple[int, ...]:
    signs = sorted(set(shape) - set(b"Aa9"))
    return tuple(zlib.crc32(x) % WIDTH for x in (RUNS.sub(rb"\1+", shape), *(b"has %c" % c for c in signs)))


def _slots(shape: bytes) -> tuple[int, ...]:
    """Of a word's shape, and of each sign in it; the cache holds no long shapes."""
    return _known_slots(shape) if len(shape) <= 64 else _known_slots.__wrapped__(shape)


def features(text: str) -> dict[int, float]:
    """Shares of hashed word shapes, of words with each sign, and of repeated words."""
    words = text.encode().split()
    if not words:
        return {}
    out: dict[int, float] = {}
    for shape, c in Counter(b" ".join(words).translate(SHAPE).split()).items():
        for slot in _slots(shape):
            out[slot] = out.get(slot, 0.0) + c
    again = sum(map(bytes.__eq__, words, words[1:]))
    slot = zlib.crc32(b"again") % WIDTH
    out[slot] = out.get(slot, 0.0) + 4.0 * again
    return {s: c / len(words) for s, c in out.items()}


def windows(text: str) -> Iterator[str]:
    """Parts of a text of few words, chosen by its hash."""
    words = text.split()
    seed = zlib.crc32(text.encode())
    for i in range(WINDOWS):
        seed = zlib.crc32(i.to_bytes(4, "little"), seed)
        n = LENGTHS[seed % len(LENGTHS)]
        if n < len(words):
            at = (seed >> 8) % (len(words) - n + 1)
            yield " ".join(words[at : at + n])


def fit(rows: list[tuple[list[int], list[float], float]], steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model with soft labels, by Adam over all rows."""
    weight, bias = np.zeros(WIDTH), 0.0
    if not rows:
        return weight, bias
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    slot = np.concatenate([np.asarray(r[0], dtype=np.int64) for r in rows])
    value = np.concatenate([np.asarray(r[1]) for r in rows])
    label = np.array([r[2] for r in rows])
    # both classes weigh the same
    share = min(max(label.mean(), 1e-3), 1 - 1e-3)
    balance = label / (2 * share) + (1 - label) / (2 * (1 - share))
    m, s = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, weights=value * weight[slot], minlength=len(rows)) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * balance
        g = np.append(np.bincount(slot, weights=value * off[owner], minlength=WIDTH) / len(rows) + 1e-5 * weight, off.mean())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        weight, bias = weight - step[:-1], bias - float(step[-1])
    return weight, bias


def _patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forget()
    for b in batches:
        yield pd.DataFrame(list(Counter(map(pattern_of, b["text"])).items()), columns=["pattern", "n"])


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for t in b["text"]:
            told = pattern_of(t)
            rows += [(told, list(f), list(f.values())) for x in (t, *windows(t)) if (f := features(x))]
        yield pd.DataFrame(rows, columns=["pattern", "slots", "shares"])


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The scorer of a (doc_id, text) table."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counted = texts.mapInPandas(_patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    chance = posteriors({r.pattern: r.n for r in counted})
    total = sum(r.n for r in counted)
    # different texts below a bar on their hash; the limit is the hard bound
    bar = min(1.0, sample / max(total, 1))
    low = F.shiftrightunsigned(F.xxhash64("text"), 11) < int(bar * 2**53)
    some = texts.where(low).groupBy(F.xxhash64("text", F.lit(1)).alias("h")).agg(F.min("text").alias("text")).select("text")
    rows = some.mapInPandas(_sampled, "pattern int, slots array<int>, shares array<double>").limit(2 * sample * (1 + WINDOWS)).collect()
    rows = sorted((list(r.slots), list(r.shares), chance.get(r.pattern, 0.5)) for r in rows)
    return fit(rows)


def score_documents(docs: DataFrame, sample: int = SAMPLE, keep_from: float = KEEP_FROM) -> DataFrame:
    """All columns of ``docs`` with __score double and __keep boolean."""
    return docs.withColumn("__score", scorer(docs, sample)).withColumn("__keep", F.col("__score") >= keep_from)


def scorer(docs: DataFrame, sample: int = SAMPLE) -> Column:
    """The score of a row of ``docs``, on whose texts the classifier is trained."""
    ship(docs.sparkSession)
    weight, bias = train(docs, sample)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        def of(t: str | None) -> float:
            f = features(t or "")
            if not f:
                return 1.0
            z = bias + sum(weight[s] * x for s, x in f.items())
            return float(round(1 / (1 + np.exp(-min(max(z, -30), 30))), 6))

        return text.map(of, na_action=None).astype("float64")

    return score("text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document: (doc_id, score, keep)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs).select("doc_id", F.col("__score").alias("score"), F.col("__keep").alias("keep"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the classifier keeps; columns as they are, whatever their names."""
    return docs.where(scorer(docs) >= KEEP_FROM)
