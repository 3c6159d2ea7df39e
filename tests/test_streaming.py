"""Streams: events in several files, neighbours as in a batch, appends by size."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from hitloom.operators import condense, knn
from hitloom.sources.store import MetricsStore
from hitloom.streaming import micro

HITS = "event_id long, hit_id long, x double, y double, z double, beta double, size long"


def shown(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(sorted(c for c in df.columns if c != "batch")).collect()), key=str)


def test_events_in_three_files(spark, tmp_path):
    rng = random.Random(0)
    rows = [(e, i, rng.random(), rng.random(), rng.random(), rng.random(), 20) for e in range(6) for i in range(20)]
    rng.shuffle(rows)
    late = [(9, i, 0.0, 0.0, 0.0, 0.5, 4) for i in range(3)]  # a row never comes
    for part in (rows[:50], rows[50:90] + late, rows[90:] + [(None, 1, 0.0, 0.0, 0.0, 0.5, 1)]):
        spark.createDataFrame(part, HITS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    like = spark.createDataFrame(rows, HITS)

    def run(name, transform):
        micro.score_events(micro.read_events(spark, str(tmp_path / "in"), like), "size", transform, str(tmp_path / name), str(tmp_path / f"cp-{name}")).awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    assert shown(run("near", lambda df: knn.knn(df, 4))) == shown(knn.knn(like, 4))
    assert shown(run("objects", lambda df: condense.condense(df, radius=0.4, threshold=0.2))) == shown(condense.condense(like, radius=0.4, threshold=0.2))
    again = run("near", lambda df: knn.knn(df, 4))  # nothing is taken twice
    assert again.count() == 4 * len(rows)


def test_neighbours_of_single_batches(spark, tmp_path):
    rows = [(e, i, i * 1.5, 0.0, 0.0, 0.5, 5) for e in range(4) for i in range(5)]
    for e in range(4):
        spark.createDataFrame([r for r in rows if r[0] == e], HITS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    like = spark.createDataFrame(rows, HITS)
    micro.score(micro.read_events(spark, str(tmp_path / "in"), like), lambda df: knn.knn(df, 3), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == shown(knn.knn(like, 3))


def test_appends_by_size(spark, tmp_path):
    """Five batches of two rows: appends after the second and the fourth, the rest by flush()."""
    like = spark.createDataFrame([("a", 1.0)], "experiment_name string, v double")
    for k in range(5):
        spark.createDataFrame([("a", float(k)), ("b", 2.0)], like.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store, cp = MetricsStore(spark, str(tmp_path / "store")), str(tmp_path / "cp")
    query = micro.append_metrics(micro.read_events(spark, str(tmp_path / "in"), like), store, "m", lambda df: df.groupBy("experiment_name").agg(F.sum("v").alias("v")), cp, flush_rows=4)
    query.awaitTermination()
    assert store.table("m").count() == 8
    micro.flush(spark, store, "m", like, cp, query.lastProgress["batchId"])
    micro.flush(spark, store, "m", like, cp, query.lastProgress["batchId"])
    assert store.table("m").count() == 10 and store.get_data("m", "b").agg(F.sum("v")).first()[0] == 10.0
    assert store.get_data("m", "a").agg(F.sum("v")).first()[0] == 10.0
