"""Repeated strings against a count of all strings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hitloom.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, lang string, key long, spans string"


def brute(rows: list[tuple]) -> list[tuple]:
    raws = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(r[i : i + 200] for _, r in raws for i in range(len(r) - 199))
    out = []
    for d, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - 199):
            if count[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(r) else 0
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows: list[tuple]) -> list[tuple]:
    return sorted(map(tuple, sd.report(spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)).collect()), key=str)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgéß𝒳") for _ in range(rng.randint(1, 8))) for _ in range(n))


def sample(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    shared = [words(rng, n) for n in (30, 45, 60, 120)]
    rows = []
    for i in range(120):
        text = words(rng, rng.randint(0, 120))
        for _ in range(rng.choice([0, 0, 1, 3])):
            s = rng.choice(shared)
            cut = rng.randrange(len(s) // 2)
            text += (s[cut:] if rng.random() < 0.5 else s[: len(s) - cut]) + words(rng, rng.randint(0, 20))
        rows.append((i, text))
    rows += [(500 + i, rows[i][1]) for i in range(20)] + [rows[3], rows[3]]
    return rows


def test_random_texts(spark):
    rows = sample(1)
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "short"), (3, "short"), (None, "x" * 199), (None, "x" * 200), (4, "ab" * 150), (5, "y" * 201), (6, "lone " + "z" * 150), (None, None), (7, "q" * 5000 + "w"), (8, "é" * 120)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert sd.remove(spark.createDataFrame([], SCHEMA)).collect() == []


def test_frequent_anchors_are_merged_across_shards(spark, monkeypatch):
    monkeypatch.setattr(sd, "LEAST_FREQUENT", 3)
    monkeypatch.setattr(sd, "FREQUENT", 1e-9)
    rows = sample(2)
    assert run(spark, rows) == brute(rows)


def test_long_texts_are_cut_into_pieces(monkeypatch):
    rng = random.Random(3)
    text = words(rng, 3000).encode()
    want = {(i, text[i : i + 200]) for i in range(len(text) - 199)}
    monkeypatch.setattr(sd, "PIECE", 1000)
    monkeypatch.setattr(sd, "BLOCK", 3000)
    number, start, count, _ = sd.contexts([b"x" * 199, text])
    assert set(number.tolist()) == {1} and (count < 256).all()
    assert {(s + k, text[s + k : s + k + 200]) for s, n in zip(start.tolist(), count.tolist()) for k in range(n)} == want


@pytest.mark.parametrize("letters", ["a", "ab", "abcdef", "\0", "a\0"])
def test_suffix_arrays(letters):
    rng = random.Random(len(letters))
    raw = "".join(rng.choice(letters) for _ in range(700)).encode()
    data = np.frombuffer(raw, np.uint8)
    sa, rank = sd.suffix_array(data, sd._words(data))
    want = sorted(range(len(raw)), key=lambda i: raw[i:])
    assert sa.tolist() == want and rank[sa].tolist() == list(range(len(raw)))
    shared = sd.common_prefixes(sd._words(data), sa, rank, np.array([0, 300]), np.array([300, 400]), 200)
    for a, b in zip(want, want[1:]):
        n = 0
        while n < 200 and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert shared[b] == n


def test_texts_are_cut(spark):
    a = words(random.Random(9), 80)
    rows = [(1, "é" + a + "tail one"), (2, "à" + a + "other end"), (3, None)]
    got = {r.doc_id: r.text for r in sd.remove(spark.createDataFrame([(d, t, "x", 5, "y") for d, t in rows], SCHEMA)).collect()}
    assert got == {1: "tail one", 2: "other end", 3: None} or got[1].endswith("tail one") and got[2].endswith("other end") and got[3] is None
