"""Hashes of words and word shingles with numpy, over the bytes of many texts at once.

A word's hash is a polynomial of its bytes modulo 2**64, taken from running sums over the whole buffer; words are
maximal runs of anything but ASCII blanks, with A-Z lower-cased.  Shingle hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_VALUE = np.arange(1, 257, dtype=U)
_VALUE[65:91] += U(32)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, U), np.ones(1, U)]
#: Bytes hashed in one go; longer texts are cut at blanks.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(_BASE) + U(salt))


_PLACE = seeds(64, 7) | U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            run = np.full(max(n, 2 * CHUNK), base, U)
            run[0] = 1
            _POWERS[k] = np.cumprod(run)
    return _POWERS[0][:n], _POWERS[1]


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words in a buffer of bytes."""
    blank = np.ones(len(data) + 2, bool)
    np.take(_BLANK, data, out=blank[1:-1])
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_VALUE[data] * power, out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts])


def _cut_long(data: bytes) -> Iterator[bytes]:
    """Pieces of about CHUNK bytes that end at blanks."""
    at = 0
    while len(data) - at > CHUNK:
        end = at + CHUNK
        view = np.frombuffer(data, np.uint8, offset=end)
        for ahead in range(0, len(view), CHUNK):
            if (found := np.flatnonzero(_BLANK[view[ahead:ahead + CHUNK]])).size:
                end += ahead + int(found[0])
                break
        else:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, after last text, hashes of all their words, number of words in each), about CHUNK bytes at a time."""
    first, held, size = 0, [], 0

    def flush(last):
        data = np.frombuffer(b" ".join(held), np.uint8)
        starts, hashes = _hash_words(data)
        edges = np.cumsum([len(x) + 1 for x in held])
        return first, last, hashes, np.diff(np.searchsorted(starts, edges), prepend=0)

    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > CHUNK:
            yield flush(k)
            first, held, size = k, [], 0
        if len(data) > CHUNK:
            hashes = np.concatenate([_hash_words(np.frombuffer(x, np.uint8))[1] for x in _cut_long(data)])
            yield k, k + 1, hashes, np.array([len(hashes)])
            first = k + 1
        else:
            held.append(data)
            size += len(data) + 1
    if held:
        yield flush(len(texts))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the hashes of its k-word shingles in order; a shorter text is one shingle, an empty one none."""
    n, at, out = len(words) - k + 1, 0, []
    if n > 0:
        runs = words[:n] * _PLACE[0]
        for j in range(1, k):
            runs += words[j:j + n] * _PLACE[j]
        runs = mix(runs)
    for c in counts.tolist():
        if c >= k:
            out.append(runs[at:at + c - k + 1])
        elif c:
            out.append(mix((words[at:at + c] * _PLACE[:c]).sum(keepdims=True) + U(c * int(_PLACE[63]) % (1 << 64))))
        else:
            out.append(words[:0])
        at += c
    return out


def shingles_of(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The shingle hashes of each text, in order of the texts."""
    for _, _, words, counts in word_hashes(texts):
        yield from shingle_hashes(words, counts, k)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    if len(hashes) < 2:
        return hashes
    s = np.sort(hashes)
    keep = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]
