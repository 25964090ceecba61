"""Digests of span lists, shared by the scanners of secrets and of personal data."""

from __future__ import annotations

import hashlib


def told(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    place = {k: n for n, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], place.get(s[0], len(place)), s[0], s[2])))


def base_digest(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(told([s for s in spans if s[0] in kinds], kinds).encode()).hexdigest()
