"""Neighbours of small events: what a plan costs, and rows against plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitloom.operators import knn


def test_small_events_are_shuffled_once(spark):
    hits = spark.range(600).select((F.col("id") % 20).alias("event_id"), F.col("id").alias("hit_id"), *(F.rand(i).alias(c) for i, c in enumerate("xyz")))
    plan = knn.knn(hits, 5, carry=("x",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and plan.count("ArrowEvalPython") == 1


def test_whole_numbers_ties_and_equal_ids(spark):
    # Event 2 has an id twice: rows of one id are no neighbours of each other. Rows of event 3 ask for more than there are.
    rows = [(1, i, i * i % 7, i % 3) for i in range(20)] + [(2, 4, 0, 0), (2, 4, 0, 1), (2, 5, 3, 0)] + [(3, 9, 1, 1)]
    hits = spark.createDataFrame(rows, "event_id int, hit_id int, x int, y int")
    got = sorted((r.event_id, r.hit_id, r.x, r.y, r.slot, r.nbr_id, r.dsq) for r in knn.knn(hits, 4, ("x", "y"), own="none", carry=("x", "y")).collect())
    want = []
    for e, i, x, y in rows:
        near = sorted((float((x - a) ** 2 + (y - b) ** 2), j) for f, j, a, b in rows if f == e and j != i)
        want += [(e, i, x, y, slot, j, d) for slot, (d, j) in enumerate(near[:4])]
    assert got == sorted(want)


def test_single_ring_in_arrays_equals_the_join(spark, monkeypatch):
    hits = spark.range(300).select((F.col("id") % 4).alias("event_id"), F.col("id").alias("hit_id"), *((F.floor(F.rand(i) * 60) / 2 - 9).alias(c) for i, c in enumerate("xyz"))).localCheckpoint()
    plan = knn.mismatches(knn.knn(hits, 5), knn.knn_single_ring(hits, 5, 4.0), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") <= 4 and "c_x" not in plan
    shown = lambda df: sorted(map(tuple, df.select("event_id", "hit_id", "slot", "nbr_id", "dsq").collect()))
    got = shown(knn.knn_single_ring(hits, 5, 4.0))
    monkeypatch.setattr(knn, "SMALL", 10)
    assert got == shown(knn.knn_single_ring(hits, 5, 4.0))


def test_covariance_shuffles_no_edges(spark):
    from hitloom.operators import edges as ed

    hits = spark.range(60).select((F.col("id") % 2).alias("event_id"), F.col("id").alias("hit_id"), F.rand(5).alias("energy"), *((1e5 + F.rand(i)).alias(c) for i, c in enumerate("xyz"))).localCheckpoint()
    near = knn.knn(hits, 5, carry=("energy", "x", "y"))
    got = ed.covariance(near, hits, "energy", ("x", "y"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = near.toPandas().groupby("hit_id")
    for r in got.collect():
        e = rows.get_group(r.hit_id)
        total = e.n_energy.sum() + 1e-4
        mx, my = (e.n_energy * e.n_x).sum() / total, (e.n_energy * e.n_y).sum() / total
        assert abs(r.cov_yx - (e.n_energy * (e.n_x - mx) * (e.n_y - my)).sum() / total) < 1e-4
