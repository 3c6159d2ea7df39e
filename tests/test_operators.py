"""Operators on small hand-made data, and against plain versions."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.operators import condense, edges, knn, matching
from hitloom.operators import select as sel
from hitloom.plans import metrics
from hitloom.sources.store import MetricsStore
from hitloom.streaming import micro


def test_guarded_threshold(spark):
    hits = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.2), (1, 2, 0.1), (1, 3, 0.4), (1, 4, 0.3)], "event_id long, hit_id long, s double")
    assert sorted(r.hit_id for r in sel.select_threshold(hits, "s", 0.5).collect()) == [0, 3]


def test_push(spark):
    hits = spark.createDataFrame([(0, i, float(i + 1)) for i in range(4)], "event_id long, hit_id long, f double")
    e = spark.createDataFrame([(0, 0, 1, 0.5), (0, 0, 2, 1.0), (0, 1, 3, 1.0), (0, 2, 2, 2.0)], "event_id long, hit_id long, nbr_id long, w double")
    got = {r.hit_id: r.pushed for r in edges.push_sum(e, hits, "f", F.col("w")).collect()}
    assert got == {0: 0.0, 1: 0.5, 2: 7.0, 3: 2.0}


def test_binned_mean(spark):
    x, y = [0, 0, 1, 1, 2, 2, 2, 2, 3, 3, 3], [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    df = spark.createDataFrame(list(zip(map(float, x), map(float, y))), "x double, y double")
    got = df.groupBy(metrics.bin_of(F.col("x"), [0, 1, 2, 3, 4]).alias("bin")).agg(F.avg("y").alias("m"), F.count("*").alias("n")).orderBy("bin").collect()
    assert [(r.m, r.n) for r in got] == [(0.0, 2), (1.0, 2), (1.75, 4), (3.0, 3)]


@pytest.mark.parametrize(("radius", "alphas", "sid"), [([1, 1, 1, 1], [0], [0, 0, 0, -1]), ([0.4, 0.45, 1, 1], [0, 1], [0, 1, 1, -1])])
def test_condense_by_hand(radius, alphas, sid):
    got, points = condense.greedy(np.array([[0.0], [0.5], [0.9], [3.0]]), np.array([0.9, 0.8, 0.3, 0.05]), np.array(radius, float), 0.1, True)
    assert got.tolist() == sid and points == alphas


def plain_condense(x, beta, radius, threshold, max_beta):
    order = sorted(range(len(beta)), key=lambda i: (-beta[i], i))
    sid, stored, free, n = [-1] * len(beta), [1e21] * len(beta), set(order), 0
    for i in order:
        if i not in free or beta[i] <= threshold:
            continue
        for j in range(len(beta)):
            d = sum((a - b) ** 2 for a, b in zip(x[i], x[j]))
            if d > radius[i] ** 2:
                continue
            if (max_beta and j in free) or (not max_beta and stored[j] * radius[i] ** 2 >= d) or j == i:
                sid[j], stored[j] = n, d
            free.discard(j)
        n += 1
    return sid


def test_condense_against_plain_loops():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n = int(rng.integers(1, 40))
        x, beta, radius = rng.integers(0, 6, (n, 2)).astype(float), rng.integers(0, 10, n) / 10, rng.uniform(0.2, 3, n)
        for mode in (True, False):
            assert condense.greedy(x, beta, radius, 0.1, mode)[0].tolist() == plain_condense(x, beta, radius, 0.1, mode)


def test_condense_table(spark):
    rows = [(e, i, 1.5 * i, 0.0, 0.0, (i * 37 % 11) / 11) for e in range(2) for i in range(12)]
    hits = spark.createDataFrame(rows, "event_id long, hit_id long, x double, y double, z double, beta double")
    got = condense.condense(hits, threshold=0.5).collect()
    kept = condense.condense(hits, threshold=0.5, keep_noise=True).collect()
    assert len(got) == 24 and any(r.sid < 0 and r.alpha_id is None for r in got)
    assert all(r.sid >= 0 for r in kept)
    assert {(r.event_id, r.hit_id) for r in got if r.hit_id == r.alpha_id} <= {(r.event_id, r.hit_id) for r in kept if r.hit_id == r.alpha_id}


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = map(int, rng.integers(1, 5, 2))
        value = rng.integers(0, 6, (n, m)) / 5
        pairs = matching.assign(value)
        small, large = sorted((n, m))
        v = value if n <= m else value.T
        best = max(sum(v[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs) == small
        assert abs(sum(value[a, b] for a, b in pairs) - best) < 1e-9


def test_grid_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(e), i, *map(float, rng.uniform(0, 10, 3))) for e in range(3) for i in range(60)]
    hits = spark.createDataFrame(rows, "event_id long, hit_id long, x double, y double, z double")
    a, b = knn.knn(hits, 6), knn.knn_grid(hits, 6, 2.5)
    key = lambda df: sorted((r.event_id, r.hit_id, r.slot, r.nbr_id) for r in df.collect())
    assert key(a) == key(b) and {r.mismatches for r in knn.mismatches(a, b, 6).collect()} == {0}


def test_store_round_trip(spark, tmp_path):
    store = MetricsStore(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([("a", 19.0, 1), ("a", float("nan"), 2)], "experiment_name string, v double, step int")
    two = spark.createDataFrame([("b", 20.0, 3, "x")], "experiment_name string, v double, step int, note string")
    store.insert("t", one)
    store.insert("t", two)
    assert set(store.field_names("t")) == {"experiment_name", "v", "step", "note"}
    assert sorted(r.v for r in store.get_data("t", "a").collect()) == [0.0, 19.0]
    assert [r.v for r in store.get_data("t", ["a", "b"], ["v"], "step > 2").collect()] == [20.0]
    other = MetricsStore(spark, str(tmp_path / "other"))
    store.copy_experiment("t", "b", other)
    store.delete_experiment("t", "a")
    assert [r.experiment_name for r in store.experiments("t").collect()] == ["b"] == [r.experiment_name for r in other.experiments("t").collect()]
    with pytest.raises(Exception):
        store.get_data("missing").collect()


def test_micro_batches(spark, tmp_path):
    like = spark.createDataFrame([("a", 1.0)], "experiment_name string, v double")
    inbox = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([("a", float(k)), ("b", 2.0)], like.schema).coalesce(1).write.mode("append").parquet(inbox)
    store = MetricsStore(spark, str(tmp_path / "store"))

    def run() -> float:
        query = micro.append_metrics(micro.read_events(spark, inbox, like), store, "m", lambda df: df.groupBy("experiment_name").agg(F.sum("v").alias("v")), str(tmp_path / "cp"))
        query.awaitTermination()
        return store.get_data("m", "b").agg(F.sum("v")).first()[0]

    assert run() == 6.0
    assert run() == 6.0  # nothing is taken twice
    scored = micro.score(micro.read_events(spark, inbox, like), lambda df: df.withColumn("w", F.col("v") * 2), str(tmp_path / "out"), str(tmp_path / "cp2"))
    scored.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_grid_neighbours_of_a_large_event(spark):
    import numpy as np

    from hitloom.operators import knn as kn

    rng = np.random.default_rng(1)
    n, k = 4000, 6
    xyz = np.concatenate([rng.normal(size=(n // 2, 3)), rng.uniform(-20, 20, size=(n // 2, 3))])
    rows = [(1, i, *map(float, p)) for i, p in enumerate(xyz)] + [(2, 1, 0.0, 0.0, 0.0), (3, 1, float("nan"), 0.0, 0.0)]
    hits = spark.createDataFrame(rows, "event_id long, hit_id long, x double, y double, z double")
    got = {}
    for r in kn.knn_grid(hits, k).collect():
        got.setdefault((r.event_id, r.hit_id), []).append((r.slot, r.nbr_id))
    assert got.pop((2, 1)) == [(0, 1)]
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    want = np.argsort(d, axis=1)[:, :k]
    assert {i: [x for _, x in sorted(v)] for (_, i), v in got.items()} == {i: w.tolist() for i, w in enumerate(want)}


def test_groups_against_plain_loops(spark):
    import random

    from hitloom.operators import groups, knn as kn

    rng = random.Random(3)
    rows = [(e, i, rng.uniform(0, 5), rng.uniform(0, 5), 0.0, rng.random()) for e in range(3) for i in range(40)]
    hits = spark.createDataFrame(rows, "event_id long, hit_id long, x double, y double, z double, beta double")
    edges = kn.knn(hits, 6)
    near = {}
    for r in edges.orderBy("slot").collect():
        near.setdefault((r.event_id, r.hit_id), []).append(r.nbr_id)
    for passes, run in ((1, groups.local_cluster), (2, groups.local_group)):
        centre = {}
        for e in range(3):
            order = sorted((r for r in rows if r[0] == e), key=lambda r: (-r[5], r[1]))
            touched = set()
            for last in range(passes):
                for r in order:
                    i = r[1]
                    if (e, i) in centre or (passes == 2 and not last and i in touched):
                        continue
                    for j in near[e, i] if r[5] >= 0.4 else [i]:
                        if (e, j) not in centre:
                            centre[e, j] = i
                            touched |= set(near[e, j])
        assert {(r.event_id, r.hit_id): r.centre_id for r in run(edges, hits, "beta", 0.4).collect()} == centre


def test_neighbours_of_large_events_equal_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(e, i, *map(float, rng.integers(0, 30, 3) / 2), float(rng.random())) for e in range(3) for i in range(90 - 40 * e)]
    rows += [(0, 900, None, 0.0, 0.0, 0.7), (0, 901, 0.0, float("nan"), 0.0, 0.1), (4, 0, 1.0, 1.0, 1.0, 0.9), (5, 0, 2.0, 2.0, 2.0, 0.2), (None, 3, 1.0, 1.0, 1.0, 0.5)]
    hits = spark.createDataFrame(rows, "event_id long, hit_id long, x double, y double, z double, beta double")
    m2 = [[1 + F.col("beta"), F.lit(0.2)], [F.lit(0.1), 1 - F.col("beta")]]
    m3 = [[F.col("beta"), F.lit(0.2), F.lit(0.0)], [F.lit(0.1), F.lit(1.0), F.lit(0.5)], [F.lit(0.0), F.lit(-0.3), F.lit(2.0)]]
    low, high = F.col("beta") < 0.5, F.col("beta") >= 0.5
    runs = {
        "radius": lambda: knn.knn(hits, 12, max_radius=2.0),
        "masks": lambda: knn.knn(hits, 5, probes=low, neighbours=high),
        "no self": lambda: knn.knn(hits, 5, own="none"),
        "self as found": lambda: knn.knn(hits, 5, neighbours=high, own="found"),
        "map of two": lambda: knn.knn_warped(hits, 5, m2, ("x", "y")),
        "map of three": lambda: knn.knn_warped(hits, 5, m3),
        "flat map": lambda: knn.knn_warped(hits, 5, [[F.lit(1.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0)]], ("x", "y")),
    }
    shown = lambda df: sorted(tuple(r) for r in df.select("event_id", "hit_id", "slot", "nbr_id", F.round("dsq", 9)).collect())
    want = {name: shown(run()) for name, run in runs.items()}
    assert all(want.values()) and not any(r[1] in (900, 901) for r in want["no self"])
    monkeypatch.setattr(knn, "SMALL", 60)  # one event goes through cells, the others do not
    for name, run in runs.items():
        assert shown(run()) == want[name], name


def test_close_pairs_against_plain_loops(spark):
    rng = np.random.default_rng(6)
    rows = [(e, i, *map(float, rng.integers(-20, 20, 2) / 2), 0.0) for e in range(2) for i in range(60)]
    hits = spark.createDataFrame(rows, "event_id long, hit_id long, x double, y double, z double")
    near = (F.col("p_x") - F.col("n_x")) ** 2 + (F.col("p_y") - F.col("n_y")) ** 2 < 9
    got = sorted((r.event_id, r.hit_id, r.nbr_id) for r in knn.close(hits, 3.0, ("x", "y", "z")).where(near).collect())
    assert got == sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 < 9)


def test_batches_are_stored_once_and_names_stay_strings(spark, tmp_path):
    store = MetricsStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("007", 1.0), ("7", 2.0)], "experiment_name string, v double")
    store.insert("t", rows, "s-0")
    store.insert("t", rows, "s-0")  # a retry
    store.insert("t", rows.where("v > 1"), "s-1")
    store.insert("t", rows.where("v < 2"))
    assert sorted((r.experiment_name, r.v) for r in store.table("t").collect()) == [("007", 1.0), ("007", 1.0), ("7", 2.0), ("7", 2.0)]
    assert store.get_data("t", "7").count() == 2 and store.field_names("t") == ["v", "experiment_name"]
    store.delete_experiment("t", "007")
    assert [r.experiment_name for r in store.experiments("t").collect()] == ["7"]
