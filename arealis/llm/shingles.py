"""Sets of word shingles as sorted arrays of 64-bit hashes, computed over whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20  # bytes of text that are hashed at a time

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[np.arange(65, 91)] = _BYTE[np.arange(97, 123)]  # A-Z count as a-z
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 4096), base, _U)
        have[0] = 1
        have = np.cumprod(have, dtype=_U)
        if n <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a text; a word's hash doesn't depend on where it stands."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = _WORD[b]
    edge = np.diff(inside)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(b) + 1, _U)
    np.cumsum(_BYTE[b] * _power(_BASE, len(b)), out=total[1:])
    return start, mix((total[stop] - total[start]) * _power(_BACK, len(b) + 1)[start])


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, in order."""
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size + len(texts[at]) <= BLOCK):
            group.append(texts[at])
            size += len(texts[at]) + 1
            at += 1
        if len(group) == 1 and len(group[0]) > BLOCK:  # in blocks that end between words
            text, parts, p = group[0], [], 0
            while p < len(text):
                q = min(p + BLOCK, len(text))
                while q < len(text) and _WORD[text[q]]:
                    q += 1
                parts.append(_hash_words(text[p:q])[1])
                p = q
            yield np.concatenate(parts)
            continue
        start, h = _hash_words(b" ".join(group))
        ends = np.cumsum([len(t) + 1 for t in group])
        yield from np.split(h, np.searchsorted(start, ends[:-1]))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of ``k`` words; of the whole if it has fewer; empty without words."""
    n = min(k, len(words))
    if not n:
        return np.empty(0, _U)
    rows = len(words) - n + 1
    total = np.full(rows, n, _U)
    for j in range(n):
        total += words[j : j + rows] * _PLACE[j % 64]
        total = mix(total) if j % 64 == 63 else total
    return np.unique(mix(total))
