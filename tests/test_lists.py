"""Neighbours as one list for each row: the same as edges, over borders of batches, and without a shuffle of edges."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from hitloom import catalog
from hitloom.operators import knn
from hitloom.sources.tables import Tables

SMALL_DIR = "/root/testdata/sf0.001"


def shown(edges):
    return sorted(tuple(map(str, r)) for r in edges.select("event_id", "hit_id", "slot", "nbr_id", "dsq", "beta", "n_beta").collect())


def table(spark):
    """Events of 1 to 40 rows on few places, so that distances tie; some scores are null."""
    rows = [(e, i, float(i * i % 5), float(i % 3), float(e), None if i % 7 == 3 else i / 50) for e in range(9) for i in range(1 + 39 * e // 8)]
    return spark.createDataFrame(rows, "event_id long, hit_id long, x double, y double, z double, beta double")


def plain(hits, k):
    """Self first, then by distance and id."""
    rows, out = [r.asDict() for r in hits.collect()], []
    for a in rows:
        near = sorted((b["hit_id"] != a["hit_id"], (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2, b["hit_id"], str(b["beta"])) for b in rows if b["event_id"] == a["event_id"])
        out += [tuple(map(str, (a["event_id"], a["hit_id"], slot, i, d, a["beta"]))) + (beta,) for slot, (_, d, i, beta) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("held", [1, 50, 1 << 16])
def test_events_go_on_over_batches(spark, monkeypatch, held):
    hits = table(spark)
    monkeypatch.setattr(knn, "HELD", held)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert shown(knn.knn(hits, 4, carry=("beta",))) == plain(hits, 4)
        assert shown(knn.exploded(knn.lists(hits, 4, carry=("beta",)), "beta")) == plain(hits, 4)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_lists_of_large_events(spark, monkeypatch):
    hits = table(spark)
    monkeypatch.setattr(knn, "SMALL", 10)
    assert shown(knn.exploded(knn.lists(hits, 4, carry=("beta",)), "beta")) == plain(hits, 4)


@pytest.mark.parametrize("name", ["knn_push_pull_condensation", "directed_graph_filter", "classifier_losses"])
def test_edges_are_not_shuffled(spark, name):
    plan = catalog.queries()[name](spark, SMALL_DIR)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert "hit_id" not in "".join(keys) and len(keys) <= 2
    assert plan.count("ArrowEvalPython") == 1


def test_losses_where_rows_are_alone(spark, tmp_path):
    """A row without neighbours has means of 0, and no part in the loss of edges."""
    hits = spark.read.parquet(f"{SMALL_DIR}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(40).withColumn("l_partkey", F.when(F.col("l_partkey") % 2 == 0, F.lit(2).cast("long")).otherwise(F.col("l_partkey")))
    hits.write.parquet(f"{tmp_path}/lineitem.parquet")
    duckdb = pytest.importorskip("duckdb")
    for name in ("knn_push_pull_condensation", "directed_graph_filter", "classifier_losses"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = con.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in want.description]
        got = catalog.queries()[name](spark, str(tmp_path)).select(*names).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 1


def test_rows_within_own_radius(spark):
    """A row without a radius finds nothing, one without a place is not found, and what lies just at the radius is not within."""
    rows = [(e, i, None if i % 11 == 5 else float(i * i % 5), float(i % 3), i / 50, None if i % 7 == 3 else float(i % 4)) for e in range(9) for i in range(1 + 39 * e // 8)]
    hits = spark.createDataFrame(rows, "event_id long, hit_id long, x double, y double, beta double, radius double")
    got = knn.within(hits, "radius", ("x", "y"), probes=F.col("hit_id") % 2 == 0, carry=("beta",))
    want = [(e, i, b, [n[1] for n in sorted(((x - u) ** 2 + (y - v) ** 2, j) for f, j, u, v, _, _ in rows if f == e and u is not None) if n[0] < r * r]) for e, i, x, y, b, r in rows if i % 2 == 0 and x is not None and r]
    assert sorted((g.event_id, g.hit_id, g.beta, [n.nbr_id for n in g.near]) for g in got.collect()) == sorted(want)
    assert all(n.n_beta == n.nbr_id / 50 for g in got.collect() for n in g.near)


def sql_and_query(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, folder).select(*(d[0] for d in want.description)).collect()
    return sorted(want.fetchall()), sorted(map(tuple, got))


def test_contamination_shuffles_rows_by_event_only(spark, monkeypatch):
    """No row is dealt to cells in small events; large ones give the same."""
    plan = catalog.queries()["neighbour_contamination"](spark, SMALL_DIR)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert len(keys) <= 2 and not re.search("hit_id|level|c_x", "".join(keys))
    for small in (256, 28):
        monkeypatch.setattr(knn, "SMALL", small)
        want, got = sql_and_query(spark, SMALL_DIR, "neighbour_contamination")
        assert got == want and len(got) > 100


def by_event_only(spark, name):
    """Rows go to Python once, and neither rows nor edges are shuffled by row."""
    plan = catalog.queries()[name](spark, SMALL_DIR)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    return "hit_id" not in "".join(keys) and len(keys) <= 2 and plan.count("ArrowEvalPython") == 1 and "Join" not in plan


@pytest.mark.parametrize("small", [256, 28])
def test_up_nodes_in_lists(spark, monkeypatch, small):
    """Small and large events alike, by the queries that share the step."""
    monkeypatch.setattr(knn, "SMALL", small)
    for name in ("pull_down", "graph_condensation_edges", "push_up", "condensation_purity"):
        assert small < 256 or name == "condensation_purity" or by_event_only(spark, name)
        want, got = sql_and_query(spark, SMALL_DIR, name)
        assert got == want


def test_pull_down_where_rows_share_places(spark, tmp_path):
    """Of up nodes at a row's own place the first one counts, and weighs most."""
    hits = spark.read.parquet(f"{SMALL_DIR}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(80)
    hits = hits.withColumns({"l_partkey": F.col("l_partkey") % 5, "l_quantity": F.floor(F.col("l_quantity") / 20) * 20.0, "l_discount": F.lit(0.0), "l_extendedprice": F.floor(F.col("l_extendedprice") / 15000) * 15000 + F.when(F.col("l_suppkey") % 2 == 0, 900.0).otherwise(100.0)})
    hits.write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = Tables(spark, str(tmp_path)).hits().collect()
    want = {}
    for a in rows:
        event = [b for b in rows if b.event_id == a.event_id]
        first = min(event, key=lambda b: (-b.beta, b.hit_id))
        near = sorted(((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, b.hit_id, b.energy) for b in event if b.beta > 0.8 or b is first)[:3]
        parts = [math.exp((near[0][0] - d) / 100) for d, _, _ in near]
        used = [i for i in range(len(near)) if i == 0 or near[i][0] > 0]
        want[a.event_id, a.hit_id] = (sum(parts[i] * near[i][2] for i in used) / sum(parts), max(near[i][2] for i in used), near[0][1])
    got = {(g.event_id, g.hit_id): (g["mean"], g["max"], g.gather) for g in catalog.queries()["pull_down"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_pull_down_mix_shuffles_rows_by_event_only(spark, monkeypatch):
    assert by_event_only(spark, "pull_down_mix")
    for small in (256, 28):
        monkeypatch.setattr(knn, "SMALL", small)
        want, got = sql_and_query(spark, SMALL_DIR, "pull_down_mix")
        assert got == want


def test_push_up_truth_shuffles_sums_only(spark, monkeypatch):
    assert by_event_only(spark, "push_up_truth")
    for small in (256, 28):
        monkeypatch.setattr(knn, "SMALL", small)
        want, got = sql_and_query(spark, SMALL_DIR, "push_up_truth")
        assert got == want
