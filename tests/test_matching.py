"""Assignments by connected parts against dense ones, and large events against tasks."""

from __future__ import annotations

import numpy as np

from hitloom.operators import matching


def total(pairs, value) -> float:
    return sum(value[r, c] for r, c in pairs)


def test_sparse_assignment():
    """Same totals as the dense assignment; only pairs that are there, each row and column once."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m = map(int, rng.integers(1, 9, 2))
        value = rng.integers(0, 8, (n, m)) / 7 * (rng.random((n, m)) < 0.5)
        pairs = matching.assign_sparse([(r, c, value[r, c]) for r in range(n) for c in range(m) if value[r, c] > 0])
        assert all(value[r, c] > 0 for r, c in pairs)
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        assert abs(total(pairs, value) - total(matching.assign(value), value)) < 1e-9


def test_parts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, m = 30, 25
        value = rng.random((n, m)) * (rng.random((n, m)) < 0.04)
        r, c = np.nonzero(value)
        at = matching.best_pairs(r * 3 + 5, c * 2, value[r, c])
        assert len(set(r[at])) == len(set(c[at])) == len(at)
        assert abs(value[r[at], c[at]].sum() - total(matching.assign(value), value)) < 1e-9
    assert len(matching.best_pairs(*(np.zeros(0),) * 3)) == 0


def test_a_long_chain():
    """Many objects in one part: no matrix of them is made."""
    n = 3000
    chain = [(i, i, 1.0) for i in range(n)] + [(i, i + 1, 1.5) for i in range(n - 1)]
    pairs = matching.assign_sparse(chain)
    value = {(r, c): x for r, c, x in chain}
    assert sum(value[p] for p in pairs) == 1.5 * (n - 1)


def test_large_events(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(e, int(rng.integers(-1, 12)), int(rng.integers(-1, 9)), float(rng.random())) for e in range(3) for _ in range(60)]
    hits = spark.createDataFrame(rows, "event_id long, t_idx int, pred int, energy double")
    shown = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    overlaps = matching.overlap(hits, "t_idx", "pred", "energy").where("t_idx % 4 = pred % 4")
    want = shown(matching.match(overlaps, "t_idx", "pred", 0.02)), shown(matching.frame(hits, "energy", 0.02))
    monkeypatch.setattr(matching, "LARGE", 5)
    assert (shown(matching.match(overlaps, "t_idx", "pred", 0.02)), shown(matching.frame(hits, "energy", 0.02))) == want
