"""What is shuffled and made how often: the plans of queries over neighbours."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hitloom import catalog
from hitloom.operators import edges as ed
from hitloom.operators import groups, knn

SMALL_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark):
    rng = np.random.default_rng(8)
    rows = [(e, i, *map(float, rng.uniform(0, 9, 3)), float(rng.random())) for e in range(4) for i in range(3 + 9 * e)]
    return spark.createDataFrame(rows, "event_id long, hit_id long, x double, y double, z double, beta double")


def test_composed_covariance_makes_edges_once(spark):
    """Without self among the neighbours too; a neighbour without neighbours of its own is left out."""
    hits = table(spark)
    edges = knn.knn(hits, 4, carry=("beta", "x", "y"), own="none").where("hit_id <> 2")
    got = ed.composed_covariance(edges, hits, "beta", ("x", "y"), F.lit(1.0))
    assert plan(got).count("ArrowEvalPython") == 1 and "hit_id" not in "".join(re.findall(r"hashpartitioning\(([^)]*)\)", plan(got)))
    e = edges.toPandas()
    e["mx"], e["my"] = e.n_beta * e.n_x, e.n_beta * e.n_y
    m = e.groupby(["event_id", "hit_id"])[["n_beta", "mx", "my"]].sum()
    m = pd.DataFrame({"mx": m.mx / (m.n_beta + 1e-3), "my": m.my / (m.n_beta + 1e-3)}).reset_index().rename(columns={"hit_id": "nbr_id"})
    j = e.drop(columns=["mx", "my"]).merge(m, on=["event_id", "nbr_id"])
    j["xy"] = j.n_beta * (j.n_x - j.mx) * (j.n_y - j.my)
    want = j.groupby(["event_id", "hit_id"])[["xy", "n_beta"]].sum()
    want = (want.xy / (want.n_beta + 1e-3)).to_dict()
    assert {(r.event_id, r.hit_id): round(r.xy, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_groups_shuffle_by_event_only(spark):
    """Rows and edges meet by event; a row without a place, without a score, or with a score that is no number is there too."""
    odd = [(3, 90, None, 0.0, 0.0, 0.9), (3, 91, 1.0, 1.0, 1.0, None), (3, 92, 2.0, 1.0, 1.0, float("nan")), (9, 1, None, 0.0, 0.0, 0.1)]
    hits = table(spark)
    hits = hits.unionByName(spark.createDataFrame(odd, hits.schema))
    edges = knn.knn(hits, 5)
    for run in (groups.local_cluster, groups.local_group):
        got = run(edges, hits, "beta", 0.4)
        assert "hit_id" not in "".join(re.findall(r"hashpartitioning\(([^)]*)\)", plan(got)))
        rows = got.collect()
        assert len(rows) == hits.count() and all(r.slot == 0 for r in rows if r.hit_id == r.centre_id)
        first = next(r for r in rows if (r.event_id, r.hit_id) == (3, 91))
        assert (first.centre_id, first.place) == (91, 0)  # no score comes first


def test_energy_conservation_keeps_its_edges(spark):
    """The scale and the sums read one table of edges."""
    got = catalog.queries()["local_energy_conservation"](spark, SMALL_DIR)
    assert "ArrowEvalPython" not in plan(got)
