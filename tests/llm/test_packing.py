"""Packing against the tokenizer itself and the rules of sequences."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from hitloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, piece int, offset long"


def test_sequences(spark):
    rng = random.Random(1)
    alphabet = ["the ", "don't", " I've", "é", "𝒳", "  ", "\n\n", "12 345", "!?", "<|endoftext|>", " ", "Straße ", "'ll", " a"]
    texts = [None, "", " ", "\n", *("".join(rng.choice(alphabet) for _ in range(rng.choice([3, 40, 900]))) for _ in range(120)), "word " * 9_000, "x" * 6_000]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    got = packing.pack(spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA), PATH).collect()
    whole = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or min(len(ids), 2048)
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_few_sequences():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 2049, 3000)
    bins, offsets, n = packing.sum_of_squares(sizes, 2048)
    assert n <= 1.03 * -(-sizes.sum() // 2048) + 1 and np.bincount(bins, sizes).max() <= 2048


def plain_sum_of_squares(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size: every open bin that fits is tried, and the sum over gaps is worked out anew."""
    gaps: list[int] = []  # of all bins, in the order in which they came to their gap
    order: list[int] = []
    placed: dict[int, tuple[int, int]] = {}

    def total() -> int:
        count: dict[int, int] = {}
        for g in gaps:
            if g:
                count[g] = count.get(g, 0) + 1
        return sum(n * n for n in count.values())

    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        tries = []
        for b, g in enumerate(gaps):
            if g >= sizes[k]:
                gaps[b] = g - sizes[k]
                tries.append((total(), g, -order[b], b))
                gaps[b] = g
        if tries:
            b = min(tries)[3]
        else:
            b = len(gaps)
            gaps.append(capacity)
            order.append(0)
        placed[k] = (b, capacity - gaps[b])
        gaps[b] -= sizes[k]
        order[b] = len(placed)
    return [placed[k] for k in range(len(sizes))]


def test_plain_rule():
    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(rng.integers(5, 40))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 60)))
        bins, offsets, n = packing.sum_of_squares(sizes, capacity)
        want = plain_sum_of_squares(sizes.tolist(), capacity)
        assert list(zip(bins.tolist(), offsets.tolist())) == want and n == len({b for b, _ in want})
