"""Hashed word shingles of texts, in numpy over whole batches.

Words are runs of characters other than space and tab to carriage return, A-Z lower-cased.
A text's set holds the 64-bit hashes of its distinct shingles of ``size`` words; a text of
fewer words has its whole sequence as its one shingle, and a text without words none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
#: Bytes of text hashed together; a longer text is hashed in pieces, cut between words.
SEGMENT = 1 << 16
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GAP = np.isin(np.arange(256), [32, *range(9, 14)])
STEP, LAST = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def times(n: int, by: np.uint64) -> np.uint64:
    """Their product modulo 2**64."""
    return U(n * int(by) % 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: What each byte, as lower case, adds to its word's hash at the first place.
BYTE = mix(np.arange(1, 257, dtype=U) * STEP)[LOWER]
INVERSE = U(pow(int(LAST), -1, 2**64))


def powers(of: np.uint64) -> np.ndarray:
    return np.concatenate([np.ones(1, dtype=U), np.cumprod(np.full(SEGMENT - 1, of, dtype=U))])


POWERS, BACK = powers(LAST), powers(INVERSE)


def power(of: np.uint64, n: int) -> np.uint64:
    return U(pow(int(of), n, 2**64))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a byte array, and where each starts.

    A word is told by its bytes times powers of their places, so running sums over the array, two
    of them for a word, give all at once; what the place of a word adds is divided out."""
    gap = np.ones(len(raw) + 2, dtype=bool)
    gap[1:-1] = GAP[raw]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=U), starts
    sums = np.zeros(len(raw) + 1, dtype=U)
    for at in range(0, len(raw), SEGMENT):
        part = BYTE[raw[at : at + SEGMENT]]
        part *= POWERS[: len(part)]
        if at:
            part *= power(LAST, at)
            part[:1] += sums[at : at + 1]
        np.cumsum(part, out=sums[at + 1 : at + 1 + len(part)])
    block, place = np.divmod(starts, SEGMENT)
    back = np.array([power(INVERSE, i * SEGMENT) for i in range(int(block[-1]) + 1)], dtype=U)
    value = (sums[ends] - sums[starts]) * BACK[place] * back[block]
    return mix(value + (ends - starts).astype(U) * STEP), starts


def _long_words(raw: np.ndarray) -> np.ndarray:
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT)
        while end < len(raw) and not GAP[raw[end]]:  # on to the end of the word
            gap = np.flatnonzero(GAP[raw[end : end + SEGMENT]])
            end = end + int(gap[0]) if len(gap) else min(len(raw), end + SEGMENT)
        found.append(word_hashes(raw[at:end])[0])
        at = end
    return np.concatenate(found)


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n words that follow each other."""
    total = np.full(len(words) - n + 1, times(n, LAST), dtype=U)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * (times(2 * i + 3, STEP) | U(1))
    return mix(total)


def _distinct(s: np.ndarray) -> np.ndarray:
    """The values of s, which is sorted in place, once each."""
    s.sort()
    new = np.ones(len(s), dtype=bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def _sets_of(words: np.ndarray, ends: Iterable[int], size: int) -> Iterator[np.ndarray]:
    """The set of each of the texts whose words follow each other."""
    # shingles across texts are hashed along, and left out
    found = _shingles(words, size) if len(words) >= size else words[:0]
    at = 0
    for end in ends:
        n = end - at
        yield _distinct(found[at : end - size + 1]) if n >= size else _shingles(words[at:end], n) if n else words[:0]
        at = end


def shingle_sets(texts: Iterable[str | None], size: int) -> Iterator[np.ndarray]:
    """The sorted set of each text, in order."""
    group: list[bytes] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        ends = np.cumsum([len(x) + 1 for x in group])
        words, starts = word_hashes(np.frombuffer(b" ".join(group) + b" ", dtype=np.uint8))
        yield from _sets_of(words, np.searchsorted(starts, ends).tolist(), size)

    for text in texts:
        raw = (text or "").encode()
        if len(raw) > SEGMENT:
            if group:
                yield from flush()
                group, held = [], 0
            words = _long_words(np.frombuffer(raw, dtype=np.uint8))
            yield from _sets_of(words, [len(words)], size)
            continue
        group.append(raw)
        held += len(raw)
        if held > SEGMENT:
            yield from flush()
            group, held = [], 0
    if group:
        yield from flush()


def set_name(s: np.ndarray) -> int:
    """A 64-bit name of a set, whatever its order."""
    return int((mix(s ^ LAST).sum(dtype=U) ^ times(len(s), STEP)).astype(np.int64)) if len(s) else 0
