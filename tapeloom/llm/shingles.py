"""Word hashes and word n-grams of whole batches of texts at once (numpy).

A word is a maximal run of letters, digits and non-ASCII characters of the lower-cased text. All words of a batch are
hashed together: prefix sums of a polynomial in the bytes give each word's value by one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CLASS = np.array([1 if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
CHUNK, TEXTS = 1 << 19, 2048
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, CHUNK)
        up, down = np.full(n, _BASE, _U), np.full(n, _INVERSE, _U)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text); texts in order."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    is_word = _CLASS[data]
    edge = np.diff(is_word.view(np.int8))
    start, stop = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    up, down = _power(len(data))
    total = np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U)
    h = mix((total[stop - 1] - total[start - 1]) * down[start] + (stop - start).astype(_U))
    bounds = np.cumsum([1, *[len(r) + 1 for r in raw]])
    return h, np.diff(np.searchsorted(start, bounds))


def ngrams(h: np.ndarray, count: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text's index, position) of every n-gram of words; short: a text of 1 to n - 1 words has one gram of all its words."""
    doc = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    if len(h) >= n:
        at = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :])
        g = np.zeros(len(at), _U)
        for k in range(n):
            g = g * _U(0x100000001B3) + h[at + k]
        g = mix(g)
    else:
        at, g = np.zeros(0, int), np.zeros(0, _U)
    if short:
        few = np.flatnonzero((count > 0) & (count < n))
        extra = np.zeros(len(few), _U)
        for i, t in enumerate(few):
            x = 0x51ED27 + int(count[t])
            for w in h[first[t] : first[t] + count[t]].tolist():
                x = (x * 0x100000001B3 + w) & 0xFFFFFFFFFFFFFFFF
            extra[i] = x
        at, g = np.r_[at, first[few]], np.r_[g, mix(extra)]
        order = np.argsort(at, kind="stable")
        at, g = at[order], g[order]
    d = doc[at] if len(at) else np.zeros(0, int)
    return g, d, at - first[d]


def chunks(texts: list[str | None], bound: int = CHUNK, most: int = TEXTS) -> Iterator[tuple[int, int]]:
    """Ranges of at most `most` texts and about `bound` characters each; a longer text is a range of its own, whole."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > a and (size + n > bound or i - a == most):
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)
