"""Personal data: pattern base plus bootstrapped contextual extraction.

Base matches (emails, IP addresses, cards, phones) are the seed entities. The two words
before a seed and its collapsed shape form a lexical pattern. Patterns and the instances
they extract are a bipartite graph, scored in rounds as in HITS until the scores settle: a pattern's confidence is
the mean score of the instances it extracts (a word pair that is followed by anything else
counts as an extraction of score 0), an instance's score is the noisy-or of its patterns'
confidences; seeds hold score 1. Patterns of high confidence then add the identifiers
that the base didn't find, as spans of kind ``context``.

Candidate patterns need ``MIN_SUPPORT`` different seeds. All that have them are used: they
are dealt by cue into blocks of about ``BLOCK`` patterns, of which one at a time is
sent to the workers, in a pass over all texts for each block.

Defined cases: null text is empty; repeated rows are counted and reported as rows; with
no seeds no pattern arises; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, staged, table
from .spans import base_digest, told

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "context")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, ANY_DIGIT = re.compile(r"[0-9]"), re.compile(r"[0-9]")
WORD = re.compile(r"\S+")
#: What a pattern may extract: one or more tokens with a digit or an at sign.
IDENTIFIER, MARK = re.compile(r"(?s)(?=.*[0-9@]).{4,}"), re.compile(r"[0-9@]")
AROUND = ".,;:!?\"'()[]"
SHAPES = (re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+"))
MIN_SUPPORT, BLOCK, CONFIDENT = 5, 50_000, 0.6
#: Scores have settled if none moves more than this between two rounds; it doubles after each ROUNDS rounds.
SETTLED, ROUNDS = 1e-3, 100


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def find_base(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) of one text, in code points; linear in its length."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            start = at
            while start > end and LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    if ANY_DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def shape(token: str) -> str:
    """Runs of digits as 9, runs of letters as a."""
    return SHAPES[1].sub("a", SHAPES[0].sub("9", token))


def cues_before(text: str, starts: list[int]) -> Iterator[tuple[int, str]]:
    """(start, cue) of sorted positions: the two words before each.

    Opening punctuation belongs to what it opens; any other beginning of the word that a
    position is in counts as a word, for the first position in it (a later one would
    have the entity before it in its cue)."""
    words = [m.span() for m in WORD.finditer(text)] if starts else []
    n, last = 0, -1
    for start in starts:
        while words[n][1] <= start:
            n += 1
        if n == last:
            continue
        last = n
        glued = text[words[n][0] : start]
        whole = [text[a:z] for a, z in words[max(0, n - 2) : n]]
        two = (whole + [glued])[-2:] if glued.strip(AROUND) else whole
        if len(two) == 2:
            yield start, " ".join(two)


def _seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text in b["text"]:
            found: dict[int, list[tuple[str, int]]] = {}
            for kind, a, z in find_base(text):
                found.setdefault(a, []).append((kind, z))
            for a, cue in cues_before(text, sorted(found)):
                rows += [(cue, shape(text[a:z]), kind, text[a:z]) for kind, z in found[a]]
        yield pd.DataFrame(rows, columns=["cue", "shape", "kind", "entity"])


def _extract(text: str, cues: Collection[str], seconds: set[str]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """(cue, n, spans of all words) of each occurrence of a cue, which word n follows;
    seconds: the cues' last words."""
    words = text.split()
    if seconds.isdisjoint(words):
        return
    hits = [n for n, w in enumerate(words) if w in seconds and n and f"{words[n - 1]} {w}" in cues]
    if not hits:
        return
    spans = [m.span() for m in WORD.finditer(text)]
    if len(spans) != len(words):  # \S and split() differ in a few separators
        words = [text[a:b] for a, b in spans]
        hits = [n for n, w in enumerate(words) if w in seconds and n and f"{words[n - 1]} {w}" in cues]
    for n in hits:
        if n + 1 < len(words):
            yield f"{words[n - 1]} {words[n]}", n + 1, spans


def _candidate(text: str, n: int, spans: list[tuple[int, int]], size: int) -> tuple[int, str]:
    """(start, text) of ``size`` words from word n on, without punctuation around them."""
    a, z = spans[n][0], spans[min(n + size, len(spans)) - 1][1]
    held = text[a:z].lstrip(AROUND)
    return z - len(held), held.rstrip(AROUND)


def _known(text: str, n: int, spans: list[tuple[int, int]], shapes: dict[str, int]) -> tuple[int, str] | None:
    """The longest candidate from word n on that has one of the shapes."""
    for size in sorted(set(shapes.values()), reverse=True):
        a, token = _candidate(text, n, spans, size)
        if IDENTIFIER.fullmatch(token) and shape(token) in shapes:
            return a, token
    return None


def _by_cue(patterns: Iterable[tuple[str, str]]) -> dict[str, dict[str, int]]:
    """The shapes of each cue, with their numbers of words."""
    out: dict[str, dict[str, int]] = {}
    for cue, form in patterns:
        out.setdefault(cue, {})[form] = len(form.split())
    return out


def _seconds(cues: Collection[str]) -> set[str]:
    return {c.rpartition(" ")[2] for c in cues}


def _occurrences(cues: dict[str, dict[str, int]]):
    seconds = _seconds(cues)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            times: dict[tuple[str, str | None, str | None, bool], int] = {}
            for text in b["text"]:
                base = None
                for cue, n, spans in _extract(text, cues, seconds):
                    key = (cue, None, None, False)
                    # each base span has a digit or an at sign in its first word
                    if MARK.search(text, *spans[n]):
                        base = base if base is not None else {s: text[s:e] for _, s, e in find_base(text)}
                        a = _candidate(text, n, spans, 1)[0]
                        # punctuation may belong to the seed
                        seed = next((base[i] for i in range(a, spans[n][0] - 1, -1) if i in base), None)
                        if seed is not None:
                            key = (cue, shape(seed), seed, True)
                    if not key[3]:
                        token = (_known(text, n, spans, cues[cue]) or _candidate(text, n, spans, 1))[1]
                        if IDENTIFIER.fullmatch(token):
                            key = (cue, shape(token), token, False)
                    times[key] = times.get(key, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in times.items()], columns=["cue", "shape", "entity", "seed", "n"])

    return run


def _blocks(patterns: DataFrame) -> Iterator[dict[str, dict[str, int]]]:
    """All (cue, shape) rows by cue, in blocks of about BLOCK rows."""
    blocks = -(-patterns.count() // BLOCK)
    for n in range(blocks):
        some = patterns if blocks == 1 else patterns.where(F.pmod(F.xxhash64("cue"), F.lit(blocks)) == n)
        if found := _by_cue((r.cue, r.shape) for r in some.select("cue", "shape").collect()):
            yield found


def learn_patterns(docs: DataFrame) -> DataFrame:
    """(cue, shape, confidence) of the confident patterns of a (doc_id, text) table.

    Scores never fall from round to round nor pass 1, so they settle; as what counts as settled doubles
    every ``ROUNDS`` rounds, at most ROUNDS * log2(2 / SETTLED) rounds are needed."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    seeds = texts.mapInPandas(_seeds, "cue string, shape string, kind string, entity string")
    support = seeds.select("cue", "shape", "entity").distinct().groupBy("cue", "shape").count().where(F.col("count") >= MIN_SUPPORT)
    empty = docs.sparkSession.createDataFrame([], "cue string, shape string, confidence double")
    seen = None
    for cues in _blocks(cut(support.select("cue", "shape"))):
        some = texts.mapInPandas(_occurrences(cues), "cue string, shape string, entity string, seed boolean, n long")
        # each block is counted before the next is loaded
        some = cut(some.groupBy("cue", "shape", "entity").agg(F.max("seed").alias("seed"), F.sum("n").alias("n")))
        seen = some if seen is None else seen.unionByName(some)
    if seen is None:
        return empty
    total = seen.groupBy("cue").agg(F.sum("n").alias("total"))
    graph = seen.where("entity is not null")
    score = graph.groupBy("entity").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for turn in count():
        # pattern step: mean score over everything its cue extracts; instance step: noisy-or
        pattern = graph.join(score, "entity").groupBy("cue", "shape").agg(F.sum(F.col("n") * F.col("score")).alias("good"))
        pattern = pattern.join(total, "cue").select("cue", "shape", (F.col("good") / F.col("total")).alias("confidence"))
        miss = F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))
        new = graph.join(pattern, ["cue", "shape"]).groupBy("entity").agg(
            F.when(F.max(F.col("seed").cast("int")) == 1, 1.0).otherwise(1 - miss).alias("score")
        )
        new = cut(new)
        moved = new.alias("n").join(score.alias("o"), "entity").agg(F.max(F.abs(F.col("n.score") - F.col("o.score")))).first()[0]
        score = new
        if (moved or 0.0) <= SETTLED * 2 ** (turn // ROUNDS):
            break
    return pattern.where(F.col("confidence") >= CONFIDENT)


def _context(text: str, cues: dict[str, dict[str, int]], seconds: set[str], base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """What the patterns find in a text outside its base spans."""
    for cue, n, spans in _extract(text, cues, seconds):
        hit = _known(text, n, spans, cues[cue])
        if hit and not any(s < hit[0] + len(hit[1]) and hit[0] < e for _, s, e in base):
            yield "context", hit[0], hit[0] + len(hit[1])


def _add_context(cues: dict[str, dict[str, int]]):
    """Adds one block's findings to ``context``, comma-joined as told."""
    seconds = _seconds(cues)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            more = [told(list(_context(t, cues, seconds, find_base(t))), KINDS) for t in b["text"]]
            yield b.assign(context=[",".join(filter(None, x)) for x in zip(b["context"], more, strict=True)])

    return run


def _find(cues: dict[str, dict[str, int]]):
    seconds = _seconds(cues)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, context in zip(b["doc_id"], b["text"], b["context"], strict=True):
                base = find_base(text)
                found = base + [(k, int(a), int(z)) for k, a, z in (s.split(":") for s in context.split(",") if s)]
                if cues:
                    found += _context(text, cues, seconds, base)
                kinds = [k for k, _, _ in found]
                rows.append((doc, *(kinds.count(k) for k in BASE), base_digest(found, BASE), told(found, KINDS)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, counts of base kinds, base_sha256, spans) of every document."""
    ship(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("context"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    last: dict[str, dict[str, int]] = {}
    for cues in _blocks(cut(learn_patterns(docs))):
        if last:
            texts = staged(texts.mapInPandas(_add_context(last), f"doc_id {kind}, text string, context string"), "contexts")
        last = cues
    return texts.mapInPandas(_find(last), f"doc_id {kind}, {FOUND}")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return find_personal_data(table(spark, sf_dir, "documents"))
