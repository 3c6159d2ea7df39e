"""Top-k search against all inner products."""

from __future__ import annotations

import math

import numpy as np
import pytest

from hitloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string"


def brute(rows: list[tuple], every: int, k: int) -> list[tuple]:
    fine = {(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, x in fine:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in fine if (i, v) != (q, x) and len(v) == len(x))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows: list[tuple], every: int = 5, k: int = 10) -> list[tuple]:
    df = spark.createDataFrame([(i, v, 0, 0.5, "x") for i, v in rows], SCHEMA)
    return sorted(map(tuple, topk.search(df, every, k).select("query_id", "rank", "vec_id", "score").collect()))


def test_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * rng.choice([0.1, 1, 3]) + 0.2 * rng.normal(size=8)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(400)]  # one vector many times: ties
    rows += [(2000, None), (2005, [1.0, None] + [0.0] * 6), (2010, [float("nan")] * 8), (2015, [float("inf")] * 8), (None, [1.0] * 8), (5, rows[5][1]), (2020, [0.0] * 8)]
    rows = [r for r in rows if r[0] != 5 or r[1] == rows[5][1]]
    assert run(spark, rows) == brute(rows, 5, 10)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, [1.0, 0.0])]) == []
    rows = [(5, [1.0, 0.0]), (6, [1.0, 0.5]), (10, [-1.0, 0.25])]
    assert run(spark, rows) == brute(rows, 5, 10)


def test_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(3, 5, 5, 0)[i % 4]).tolist()) for i in range(300)]
    rows += [(10, rng.normal(size=5).tolist()), (10, rng.normal(size=3).tolist()), (11, rng.normal(size=5).tolist())]
    assert run(spark, rows) == brute(rows, 5, 10)


def test_scores_that_leave_64_bits_raise(spark):
    with pytest.raises(Exception, match="may reach"):
        run(spark, [(5, [1e17, 0.0]), (6, [1e17, 1.0])])


def test_bounds_stop_the_search_and_hold(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 6)) * 8
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=6)).tolist()) for i in range(6000)]
    df = spark.createDataFrame([(i, v, 0, 0.5, "x") for i, v in rows], SCHEMA)
    got = topk.search(df, 100, 10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 100, 10)
    # 40 annuli at least; the nearest by inner product lie in few of them.
    assert max(r.opened for r in got) <= 15 and sum(r.opened for r in got) / len(got) < 6

    q, v = (rng.integers(-900, 900, size=(n, 5)) for n in (30, 200))
    pivots = rng.integers(-900, 900, size=(7, 5)).astype(float)
    d = topk.distances(v, pivots)
    far = topk.bounds(q, topk.distances(q, pivots), d.min(0)[None], d.max(0)[None], np.array([(v**2).sum(1).max()], float))
    assert (far[:, 0] >= (q @ v.T).max(1)).all()
