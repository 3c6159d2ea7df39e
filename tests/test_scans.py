"""Scans by parts and quantiles by narrowing against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.operators import scans
from hitloom.operators.quantiles import quantiles

ROWS = "event_id long, pos long, v double, w double"


def table(spark, seed: int):
    rng = np.random.default_rng(seed)
    rows = [(e, i + 1, float(rng.integers(-6, 7)) / 4, float(rng.choice([0.5, 0.25, 1.0]))) for e, n in ((0, 53), (1, 1), (2, 16), (3, 17)) for i in range(n)]
    return rows, spark.createDataFrame(rows, ROWS).repartition(5)


@pytest.mark.parametrize("descending", [False, True])
def test_numbered(spark, descending):
    rows, df = table(spark, 0)
    df = df.withColumn("v", F.when(F.col("pos") == 5, None).otherwise(F.col("v")))
    got = {(r.event_id, r.pos): r.n for r in scans.numbered(df, "v", ["pos"], "n", descending=descending, part=8).collect()}
    for e in range(4):
        mine = [(p == 5, (-v if descending else v) if p != 5 else 0, p) for k, p, v, _ in rows if k == e]
        assert {p: got[e, p] for *_, p in mine} == {p: n for n, (*_, p) in enumerate(sorted(mine), 1)}


def test_sums(spark):
    rows, df = table(spark, 1)
    out = scans.moving_sum(scans.running_sum(df, "pos", "v", "run", part=8), "pos", "v", 3, 2, "move", part=8)
    got = {(r.event_id, r.pos): (r.run, r.move) for r in out.collect()}
    assert len(got) == len(rows)
    for e, p, _, _ in rows:
        mine = {q: v for k, q, v, _ in rows if k == e}
        assert got[e, p] == (sum(v for q, v in mine.items() if q <= p), sum(v for q, v in mine.items() if p - 3 <= q <= p + 2))
    # A reach of more than a part.
    far = {(r.event_id, r.pos): r.move for r in scans.moving_sum(df, "pos", "v", 20, 0, "move", part=8).collect()}
    assert all(far[e, p] == sum(v for k, q, v, _ in rows if k == e and p - 20 <= q <= p) for e, p, _, _ in rows)


@pytest.mark.parametrize(("part", "depth"), [(4, 2), (64, 0), (2, 1)])
def test_recurrence(spark, part, depth):
    rows, df = table(spark, 2)
    got = {(r.event_id, r.pos): r.y for r in scans.affine_scan(df, "pos", F.col("w"), F.col("v"), "y", part=part, depth=depth).collect()}
    y = 0.0
    for e, p, v, w in rows:
        y = v if p == 1 else w * y + v
        assert got[e, p] == pytest.approx(y, abs=1e-12)


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.normal(size=400)] + [("b", 7.0)] * 300 + [("b", float(x)) for x in rng.integers(0, 20, 100)] + [("c", 1.5), (None, 2.0), (None, 4.0), ("a", None), ("a", float("nan")), ("d", None)]
    rows += [("e", float(10.0**k)) for k in range(-300, 300, 7)] + [("e", 1e-300 * k) for k in range(50)] + [("f", -1.7e308), ("f", 1.7e308), ("f", 0.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    shares = [0.0, 0.16, 0.5, 0.84, 1.0]
    got = {(r.g, r.share): r.quantile for r in quantiles(df, "x", shares, ["g"]).collect()}
    for g in ("a", "b", "c", None, "e"):
        values = [x for k, x in rows if k == g and x is not None and x == x]
        for s in shares:
            assert got[g, s] == pytest.approx(np.percentile(values, s * 100), rel=1e-12)
    assert got["f", 0.5] == 0.0 and not any(g == "d" for g, _ in got)
    whole = {r.share: r.quantile for r in quantiles(df.where("g = 'a'"), "x", shares).collect()}
    assert whole == {s: got["a", s] for s in shares}
    assert quantiles(df.where("false"), "x", shares).collect() == []
