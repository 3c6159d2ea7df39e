"""Large events in rounds of joins give what tasks give."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hitloom.operators import condense, groups, knn


def shown(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


def table(spark, events: int, n: int, seed: int):
    rng = np.random.default_rng(seed)
    rows = [(e, i, *map(float, rng.integers(0, 12, 3) / 2), float(rng.integers(0, 40)) / 40, float(rng.choice([0.0, 0.3, 0.8, 1.0, 2.5])), bool(rng.random() < 0.1)) for e in range(events) for i in range(n - 30 * e)]
    rows += [(0, 900, float("nan"), 0.0, 0.0, 0.99, 1.0, False), (0, 901, 1.0, 1.0, 1.0, 0.99, 1.0, True)]
    return spark.createDataFrame(rows, "event_id long, hit_id long, x double, y double, z double, beta double, reach double, alone boolean")


@pytest.mark.parametrize("more", [{}, {"max_beta": True}, {"keep_noise": True, "singletons": "alone", "keep": ("beta",)}], ids=["default", "max_beta", "all"])
def test_condense(spark, monkeypatch, more):
    """Many ties in place and score; radii of several levels, none at all, and a row without a place."""
    hits = table(spark, 2, 110, 1)
    args = {"radius": F.col("reach"), "threshold": 0.3, **more}
    if "singletons" in more:
        args["singletons"] = F.col("alone")
    want = shown(condense.condense(hits, **args))
    monkeypatch.setattr(condense, "LARGE", 90)  # one event goes through rounds
    assert shown(condense.condense(hits, **args)) == want


def test_groups(spark, monkeypatch):
    hits = table(spark, 2, 110, 2).where("not isnan(x)")
    edges = knn.knn(hits, 5)
    for run in (groups.local_cluster, groups.local_group):
        want = shown(run(edges, hits, "beta", 0.4))
        monkeypatch.setattr(groups, "LARGE", 90)
        assert shown(run(edges, hits, "beta", 0.4)) == want
        monkeypatch.undo()


def test_crowded_cell(spark):
    """Nine rows in ten share a place: they are one node of the grid, and neighbours equal brute force."""
    rng = np.random.default_rng(3)
    n, k = 4000, 5
    xyz = rng.uniform(-10, 10, (n, 3))
    xyz[rng.random(n) < 0.9] = [1.0, 2.0, 3.0]
    hits = spark.createDataFrame(pd.DataFrame({"event_id": 1, "hit_id": np.arange(n), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))
    got = knn.knn(hits, k).toPandas().sort_values(["hit_id", "slot"]).nbr_id.to_numpy().reshape(n, k)
    d = sum((xyz[:, None, c] - xyz[None, :, c]) ** 2 for c in range(3))
    d[np.arange(n), np.arange(n)] = -1
    want = np.argsort(d, axis=1, kind="stable")[:, :k]
    assert (got == want).all()


def test_whole_numbers(spark, monkeypatch):
    """Ids and coordinates may be integers of any width; both ways give the same types and rows."""
    rows = [(1, i, i % 7, i * i % 11) for i in range(40)]
    hits = spark.createDataFrame(rows, "event_id int, hit_id int, x int, y int")
    want = knn.knn(hits, 4, ("x", "y"), carry=("x",))
    rows = shown(want)
    monkeypatch.setattr(knn, "SMALL", 10)
    got = knn.knn(hits, 4, ("x", "y"), carry=("x",))
    assert shown(got) == rows and dict(got.dtypes) == dict(want.dtypes)
