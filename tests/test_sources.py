"""CSV events, generated events, and shapes against plain numpy."""

from __future__ import annotations

import numpy as np

from hitloom.operators import shapes
from hitloom.sources import blobs, csv


def test_csv_hits_of_fast_particles(spark, tmp_path):
    files = {
        "hits": ["1,0,0,1,7,2,1", "2,1,0,2,7,2,1", "3,0,1,3,7,2,1"],
        "cells": ["1,0,0,0.5", "1,0,1,0.25", "2,3,3,9"],
        "particles": ["10,0,0,0,2,0,5,1,2", "11,0,0,0,1,1,5,-1,1"],
        "truth": ["1,10,0,0,0,0,0,0,1", "2,11,0,0,0,0,0,0,1", "3,10,0,0,0,0,0,0,1"],
    }
    read = {}
    for name, lines in files.items():
        header = ",".join(field.split()[0] for field in csv.SCHEMAS[name].split(", "))
        (tmp_path / f"{name}.csv").write_text("\n".join([header, *lines]) + "\n")
        read[name] = csv.scan(spark, str(tmp_path / f"{name}.csv"), csv.SCHEMAS[name])
    got = csv.standard_hits(**read).select("hit_id", "particle_id", "energy").collect()
    assert sorted(map(tuple, got)) == [(1, 10, 0.75), (3, 10, 0.0)]


def test_generated_events(spark):
    of = spark.range(5).withColumnRenamed("id", "event_id")
    hits = blobs.events(of, seed=3)
    sizes = {(r.event_id, r.t_idx): r["count"] for r in hits.groupBy("event_id", "t_idx").count().collect()}
    for e in range(5):
        assert 2 <= sum(k[0] == e and k[1] >= 0 for k in sizes) <= 6 and sizes[e, -1] == 10
    assert all(1800 <= n <= 1899 for (_, t), n in sizes.items() if t >= 0)
    assert hits.select("event_id", "hit_id").distinct().count() == hits.count()
    assert hits.exceptAll(blobs.events(of, seed=3)).isEmpty()
    assert not hits.exceptAll(blobs.events(of, seed=4)).isEmpty()
    assert blobs.events(of.where("false")).isEmpty()


def test_outlier_scores_on_two_of_three_axes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 3))
    rows = [(0, i, *map(float, v)) for i, v in enumerate(x)] + [(1, 0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "event_id long, hit_id long, a double, b double, c double")
    got = [r.score for r in shapes.outlier_scores(df, ("a", "b", "c"), 2, 10).orderBy("hit_id").collect()]
    z = (x - x.mean(0)) / x.std(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(got, np.sqrt((u[:, :2] ** 2).sum(1) * len(z)))


def test_blob_events_follow_the_table(spark):
    from hitloom.plans.summaries import blob_events
    from hitloom.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert blob_events(t).select("event_id").distinct().count() == t.table("supplier").count()


def test_experiments_of_any_name_are_deleted(spark, tmp_path):
    from hitloom.sources.store import MetricsStore

    store = MetricsStore(spark, str(tmp_path))
    names = ["a/b: 100% [x]", "plain", "a=b"]
    store.insert("t", spark.createDataFrame([(n, k) for k, n in enumerate(names)], "experiment_name string, v long"))
    store.delete_experiment("t", names[0])
    store.delete_experiment("t", names[2])
    assert [tuple(r) for r in store.table("t").select("experiment_name", "v").collect()] == [("plain", 1)]
