"""Near-duplicate groups against all pairs."""

from __future__ import annotations

import random
import re

from hitloom.llm import jaccard_join
from hitloom.llm.words import shingle_sets

SCHEMA = "doc_id long, text string, lang string, k long, label string"


def shingles(text: str | None) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows: list[tuple]) -> list[tuple]:
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                top[find(i)] = find(j)
    ids: dict[int, list] = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {g: min((d for d in v if d is not None), default=None) for g, v in ids.items()}
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows: list[tuple]) -> list[tuple]:
    df = spark.createDataFrame([(d, t, None, 7, "x") for d, t in rows], SCHEMA)
    return sorted(map(tuple, jaccard_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_shingle_sets_have_the_right_sizes():
    texts = [None, "", "  \t", "One two", "one TWO", "a b c d e", "a b c d e f a b c d e", "x y z\x0bq"] * 3
    got = list(shingle_sets(texts, block=20))
    assert [len(g) for g in got] == [len(shingles(t)) for t in texts]
    assert (got[3] == got[4]).all() and not (got[5] == got[3]).all()


def test_many_rows_without_an_id_or_with_one_id(spark):
    rng = random.Random(4)
    base = [" ".join(str(rng.randrange(1000)) for _ in range(60)) for _ in range(40)]
    near = [b.rsplit(" ", 1)[0] + " changed" for b in base[:20]]
    rows = [(None, t) for t in base + near[:10]] + [(7, t) for t in near[10:] + base[:5]] + [(100 + i, t) for i, t in enumerate(base[:3])]
    assert run(spark, rows) == brute(rows)
    kept = jaccard_join.one_of_each(spark.createDataFrame([(d, t, None, 7, "x") for d, t in rows], SCHEMA))
    assert kept.count() == 40


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (9, "ONE  two"), (5, "one two three"), (None, "one two"), (7, "lone"), (7, "lone"), (None, "other words"), (8, "word " * 50_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_random_near_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for group in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 200]))]
        if group % 3 == 0:
            base[3:3] = passage
        for _ in range(rng.choice([1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((rng.randrange(10_000), " ".join(copy)))
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


def test_region_links_are_exact():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.choice(10_000, 120, replace=False)

    def near() -> np.ndarray:
        keep = base[rng.random(120) < rng.uniform(0.75, 1)]
        return np.unique(np.concatenate([keep, rng.integers(10_000, 20_000, rng.integers(0, 25))]))

    points, probes = [near() for _ in range(150)], [near() for _ in range(40)]
    want = {(i, j) for i, a in enumerate(probes) for j, b in enumerate(points) if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
    assert set(jaccard_join.region_links(points, probes)) == want and want
