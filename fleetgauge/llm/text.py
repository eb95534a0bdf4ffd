"""Words of texts as 64-bit hashes, for whole slices of texts at once.

Words are what ``text.lower().split()`` gives. Two texts have equal hashes where
their words are equal, whatever white space stands between.
"""

from __future__ import annotations

import numpy as np

#: Words to a shingle.
SHINGLE = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads every bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 20)
        base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        ones = np.full(size, base, np.uint64)
        ones[0] = 1
        _powers = np.cumprod(ones)
        ones[1:] = inverse
        _inverse = np.cumprod(ones)
    return _powers, _inverse


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte times power, by which any substring's hash is a difference."""
    power, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return sums


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of the text it stands in."""
    joined = "\n".join(" ".join((t or "").lower().split()) for t in texts)
    data = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    newline = data == 10
    inside = ~(newline | (data == 32))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = prefix_hash(data)
    _, inverse = powers(len(data) + 1)
    hashes = (sums[end] - sums[start]) * inverse[start]
    text = np.cumsum(newline)[start] if len(start) else np.zeros(0, np.int64)
    return mix(hashes + (end - start).astype(np.uint64)), text.astype(np.int64)


def shingle_hashes(
    words: np.ndarray, text: np.ndarray, short: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of five words, and its text.

    With ``short``, a text of one to four words is one shingle; without, it has none.
    """
    n = len(words)
    factor = [np.uint64(pow(0xD6E8FEB86659FD93, j, 1 << 64)) for j in range(SHINGLE)]
    full = max(0, n - SHINGLE + 1)
    total = np.zeros(full, np.uint64)
    for j in range(SHINGLE):
        total += words[j : j + full] * factor[j]
    whole = text[:full] == text[SHINGLE - 1 :]
    hashes, of = mix(total[whole]), text[:full][whole]
    if short and n:
        first = np.flatnonzero(np.diff(text, prepend=-1))
        size = np.diff(np.append(first, n))
        few = first[size < SHINGLE]
        held = size[size < SHINGLE]
        sums = np.zeros(len(few), np.uint64)
        for j in range(SHINGLE - 1):
            has = held > j
            sums[has] += words[few[has] + j] * factor[j]
        sums = mix(sums + held.astype(np.uint64))
        hashes, of = np.append(hashes, sums), np.append(of, text[few])
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    return hashes, of
