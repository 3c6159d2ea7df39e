"""Greedy density-peak clustering of events, and what follows from an assignment.

Events of bounded size come together in a single shuffle on event_id; larger ones go through rounds of joins on cells, so
that no task holds them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.operators import rounds
from hitloom.operators.events import large_events, per_event

#: Rows of an event up to which one task condenses it.
LARGE = 100_000
ASSIGNED = "event_id long, hit_id long, sid int, alpha_id long"


def greedy(coords: np.ndarray, beta: np.ndarray, radius: np.ndarray, threshold: float, max_beta: bool) -> tuple[np.ndarray, list[int]]:
    """Object number of each row (-1: none) and the rows of the condensation points, best beta first.

    A point takes what lies within its own radius. With max_beta the first taker keeps a row; else a later
    point takes it over where the squared distance so far, times its squared radius, is no less than its own.
    """
    n = len(beta)
    sid, stored = np.full(n, -1), np.full(n, 1e21)
    covered = np.zeros(n, bool)
    points: list[int] = []
    for i in np.lexsort((np.arange(n), -beta)).tolist():
        if beta[i] <= threshold:
            break
        if covered[i]:
            continue
        d = ((coords - coords[i]) ** 2).sum(1)
        inside = d <= radius[i] ** 2
        take = inside & ~covered if max_beta else inside & (stored * radius[i] ** 2 >= d)
        take[i] = True
        sid[take], stored[take] = len(points), d[take]
        covered |= inside
        covered[i] = True
        points.append(i)
    return sid, points


def condense(hits: DataFrame, beta: str = "beta", radius: Column | float = 1.0, threshold: float = 0.1, coords: tuple[str, ...] = ("x", "y", "z"), max_beta: bool = False, keep_noise: bool = False, singletons: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """event_id, hit_id, sid (-1: noise), alpha_id (null: noise) and the columns of keep of every row; rows with beta > threshold may be points.

    keep_noise: rows that no point takes become objects of their own, numbered first. singletons: rows that
    are objects of their own in any case, numbered last; they neither take rows nor are taken. Events of more than
    LARGE rows are condensed in rounds, to the same result; looking for them is one job on event_id.
    """
    alone = (singletons if singletons is not None else F.lit(False)).alias("_alone")
    rows = hits.select("event_id", "hit_id", *keep, alone, *(F.col(c).cast("double").alias(f"_{c}") for c in coords), F.col(beta).cast("double").alias("_b"), (radius if isinstance(radius, Column) else F.lit(radius)).cast("double").alias("_r"))

    def one(event: pa.Table) -> pa.Table:
        xyz = np.stack([event[f"_{c}"].to_numpy() for c in coords], axis=1)
        ids = event["hit_id"].to_numpy()
        own = np.array(event["_alone"].to_pylist(), bool)
        free = np.flatnonzero(~own)
        sid, alpha = np.full(len(ids), -1), ids.copy()
        found, points = greedy(xyz[free], event["_b"].to_numpy()[free], event["_r"].to_numpy()[free], threshold, max_beta)
        sid[free] = found
        sid[own] = len(points) + np.arange(own.sum())
        held = free[found >= 0]
        alpha[held] = ids[free[np.array(points, np.int64)[found[found >= 0]]]]
        noise = sid < 0
        if keep_noise:
            sid = np.where(noise, np.cumsum(noise) - 1, sid + noise.sum())
            alpha, noise = np.where(noise, ids, alpha), np.zeros(len(ids), bool)
        out = {"event_id": event["event_id"], "hit_id": ids, "sid": sid.astype(np.int32), "alpha_id": pa.array(alpha, mask=noise)}
        return pa.table(out | {name: event[name] for name in keep})

    more = [f"{f.name} {f.dataType.simpleString()}" for f in hits.select(*keep).schema.fields] if keep else []
    schema = ", ".join([ASSIGNED, *more])
    large = large_events(rows, LARGE)
    if large is None:
        return per_event(rows, one, schema, "hit_id")
    small = per_event(rows.join(large, "event_id", "left_anti"), one, schema, "hit_id")
    return small.unionByName(_in_rounds(rows.join(large, "event_id", "left_semi"), coords, threshold, max_beta, keep_noise, keep))


def _in_rounds(rows: DataFrame, coords: tuple[str, ...], threshold: float, max_beta: bool, keep_noise: bool, keep: tuple[str, ...]) -> DataFrame:
    """condense() of large events."""
    named = {"_b": "score", "_r": "radius"}
    free = rows.where("NOT coalesce(_alone, false)").withColumnsRenamed(named)
    told = rounds.condensed(free.select("event_id", "hit_id", "score", "radius", *(f"_{c}" for c in coords)), [f"_{c}" for c in coords], threshold, max_beta)
    event = Window.partitionBy("event_id").orderBy("hit_id")
    points = told.groupBy("event_id").agg((F.max("sid") + 1).alias("_points"))
    own = rows.where("coalesce(_alone, false)").join(points, "event_id", "left").select("event_id", "hit_id", (F.coalesce("_points", F.lit(0)) + F.row_number().over(event) - 1).alias("sid"), F.col("hit_id").alias("alpha_id"))
    told = told.unionByName(own)
    if keep_noise:
        noise = told.where("sid < 0").select("event_id", "hit_id", (F.row_number().over(event) - 1).alias("sid"), F.col("hit_id").alias("alpha_id"))
        many = noise.groupBy("event_id").agg(F.count("*").cast("int").alias("_noise"))
        held = told.where("sid >= 0").join(many, "event_id", "left").select("event_id", "hit_id", (F.col("sid") + F.coalesce("_noise", F.lit(0))).alias("sid"), "alpha_id")
        told = noise.unionByName(held)
    told = told.withColumn("sid", F.col("sid").cast("int"))
    return told.join(rows.select("event_id", "hit_id", *keep), ["event_id", "hit_id"]) if keep else told


def condense_scaled(hits: DataFrame, scale: Column, distance: float, threshold: float, **more) -> DataFrame:
    """condense() with each row's own distance scale times one distance as its radius."""
    return condense(hits, radius=scale * distance, threshold=threshold, **more)


def alpha_maps(assigned: DataFrame) -> DataFrame:
    """slot (sid + 1; 0: noise), representative (the alpha; of noise its last row) and ragged (the object's place in its event) of each row."""
    event = Window.partitionBy("event_id")
    last = F.max(F.when(F.col("sid") < 0, F.col("hit_id"))).over(event)
    return assigned.select("event_id", "hit_id", (F.col("sid") + 1).alias("slot"), F.coalesce("alpha_id", last).alias("representative"), (F.dense_rank().over(event.orderBy("sid")) - 1).alias("ragged"))


def object_energy(assigned: DataFrame, hits: DataFrame) -> DataFrame:
    """Energy of each row's object; 0 for noise."""
    w = Window.partitionBy("event_id", "sid")
    rows = assigned.join(hits.select("event_id", "hit_id", "energy"), ["event_id", "hit_id"])
    return rows.withColumn("object_energy", F.when(F.col("sid") >= 0, F.sum("energy").over(w)).otherwise(0.0))


def normalised_labels(hits: DataFrame, label: str) -> DataFrame:
    """Labels of each event as 0, 1, ... in order of first appearance; negative ones stay -1."""
    first = hits.where(F.col(label) >= 0).groupBy("event_id", label).agg(F.min("hit_id").alias("_f"))
    dense = first.withColumn("dense", F.row_number().over(Window.partitionBy("event_id").orderBy("_f")) - 1).drop("_f")
    return hits.join(dense, ["event_id", label], "left").withColumn("dense", F.coalesce("dense", F.lit(-1)))
