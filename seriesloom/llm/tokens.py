"""Cached encoding with the vocabulary files of the tokenizers library.

Texts are cut where the pre-tokenizer always cuts, and the tokens of each short chunk are
kept in a bounded cache in the Python worker: prose repeats its words, so most chunks
are encoded once a worker and not once an occurrence.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np

#: Chunks that a worker remembers; the newest go first, as the earliest are the commonest.
CACHE, KEEP = 900_000, 700_000
#: Chunks and whole words in one call of the library, and chunks of texts handled together.
CALL, WORDS, TOGETHER = 20_000, 500, 60_000
SAFE = re.compile(r"(?<=\S)(?= \S)")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str) -> Any:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def words_of(text: str) -> list[str]:
    """Chunks for a lower-casing tokenizer that drops white space: between spaces and line feeds."""
    return (text.lower() if text.isascii() else text).replace("\n", " ").split(" ")


def spaced_words_of(text: str) -> list[str]:
    """Chunks for a byte-level tokenizer; joined they are the text.

    Its pre-tokenizer always cuts before a single space between two other characters,
    and around a single line feed between two."""
    if " ".join(text.split()) == text.replace("\n", " ") and "\0" not in text:
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    return SAFE.split(text)


def _small(word: str) -> str:
    """Lower case where that is plain: one character for one."""
    if word.islower() or not (word.isascii() or max(word) < "\u0100"):
        return word
    return word.lower()


def _all_letters(word: str) -> bool:
    """Letters only, also when normalised: a mark split off at the end would join the sign behind it."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class Cached:
    """Encodes texts to little-endian unsigned 32-bit ids, through the cache."""

    def __init__(self, path: str, chunks: Callable[[str], list[str]]):
        self.tokenizer, self.chunks = load(path), chunks
        self.known: dict[str, bytes] = {"": b""}

    def _learn(self, words: list[str]) -> None:
        """Encodes unknown chunks. The lower-casing tokenizer cuts words off a comma or full
        stop behind them and takes them whole, so most chunks come down to few words."""
        if self.chunks is not words_of:
            return self._learn_chunks(words)
        parts = {w: (_small(w[:-1]), w[-1]) if w[-1] in ".," and _all_letters(w[:-1]) else (_small(w), "") if _all_letters(w) else (w, "") for w in words}
        base = {b for b, _ in parts.values()}.difference(self.known)
        self._learn_words(sorted(b for b in base if _all_letters(b)))
        self._learn_chunks(sorted({*(b for b in base if not _all_letters(b)), ".", ","}.difference(self.known)))
        self.known.update([(w, self.known[b] + self.known[end]) for w, (b, end) in parts.items() if w != b])

    def _learn_words(self, words: list[str]) -> None:
        for at in range(0, len(words), WORDS):
            some = words[at : at + WORDS]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            owner = np.array(e.word_ids, dtype=np.int64)
            if not len(owner) or owner[-1] != len(some) - 1:
                self._learn_chunks(some)
                continue
            ids = np.array(e.ids, dtype="<u4").tobytes()
            ends = np.cumsum(np.bincount(owner, minlength=len(some))) * 4
            self.known.update(zip(some, [ids[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], strict=True))

    def _learn_chunks(self, words: list[str]) -> None:
        for at in range(0, len(words), CALL):
            some = words[at : at + CALL]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4").tobytes()
            ends = np.cumsum(np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(some))) * 4 if e.ids else [0] * len(some)
            start = 0
            for w, end in zip(some, map(int, ends), strict=True):
                self.known[w] = ids[start:end]
                start = end

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        gc.freeze()  # what is kept so far need not be visited again
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self.chunks(text))
            size += len(group[-1])
            if size >= TOGETHER:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterator[bytes]:
        if len(self.known) > CACHE:
            for _ in range(len(self.known) - KEEP):
                self.known.popitem()
        if missing := set().union(*group).difference(self.known):
            self._learn(sorted(missing))
        get = self.known.__getitem__
        for words in group:
            yield b"".join(map(get, words))


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> Cached:
    """The worker's encoder of a vocabulary file."""
    return Cached(path, spaced_words_of if spaced else words_of)


def forget() -> None:
    """Gives the chunks that this worker remembers back to another stage's memory."""
    encoder.cache_clear()
