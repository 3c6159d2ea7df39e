"""Shingle sets of whole batches of texts by array operations on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Fixed for good: hashes of different runs must agree.
BASE = 0x9E3779B97F4A7C15 | 1
PLACES = np.array([0xD6E8FEB86659FD93, 0xA5CB9243F5E7A5B1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
MULTIPLIERS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MULTIPLIERS[0]
    x = (x ^ (x >> np.uint64(27))) * MULTIPLIERS[1]
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE and its inverse to the powers 0 to n at least, modulo 2**64. One table is kept, the longest so far."""
    if len(_POWERS[0]) <= n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """run with run[j] - run[i] = BASE**i times the polynomial hash of data[i:j]."""
    up, _ = powers(1 << len(data).bit_length())
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=run[1:])
    return run


def span_hash(run: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    _, down = powers(1 << (len(run) - 1).bit_length())
    return mixed((run[stops] - run[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def shingle_sets(texts: Iterable[str | None], size: int = 5, block: int = 1 << 19) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of five lower-cased words.

    Fewer words make one shingle; null, empty and blank texts make none. Two different shingles share
    a 64-bit hash with a probability of about 5e-20.
    """
    part: list[bytes] = []
    total = 0
    for text in texts:
        part.append((text or "").encode())
        total += len(part[-1]) + 1
        if total >= block:
            yield from _block(part, size)
            part, total = [], 0
    if part:
        yield from _block(part, size)


def _block(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    blank = BLANK[data]
    edge = np.ones(len(data), bool)
    edge[1:] = blank[1:] != blank[:-1]
    starts, stops = np.flatnonzero(edge & ~blank), np.flatnonzero(edge & blank)
    if len(stops) and len(starts) and stops[0] < starts[0]:
        stops = stops[1:]
    word = span_hash(prefix_hash(data), starts, stops[: len(starts)])
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    last = np.searchsorted(starts, ends).tolist()
    n = len(word) - size + 1
    rows = mixed(sum((word[j : j + n] * PLACES[j] for j in range(size)), np.zeros(max(n, 0), np.uint64))) if n > 0 else word[:0]
    first = 0
    for end in last:
        k = end - first
        if k >= size:
            yield np.unique(rows[first : end - size + 1])
        elif k:
            whole = np.sum(word[first:end] * PLACES[:k], dtype=np.uint64, keepdims=True) + np.uint64(k)
            yield mixed(mixed(whole) + np.uint64(k))
        else:
            yield word[:0]
        first = end


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits, as two signed longs, that stand for a whole set."""
    a = mixed(hashes).sum(dtype=np.uint64)
    b = mixed(hashes * PLACES[0] + PLACES[1]).sum(dtype=np.uint64)
    n = np.uint64(len(hashes))
    return tuple(mixed(np.array([a + n, b ^ n], np.uint64)).view(np.int64).tolist())
