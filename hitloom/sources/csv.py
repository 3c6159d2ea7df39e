"""Collision events in CSV files: hits, cells, particles, and the truth that ties hits to particles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the public tracking data, as its files name them.
SCHEMAS = {
    "hits": "hit_id long, x double, y double, z double, volume_id int, layer_id int, module_id int",
    "cells": "hit_id long, ch0 int, ch1 int, value double",
    "particles": "particle_id long, vx double, vy double, vz double, px double, py double, pz double, q int, nhits int",
    "truth": "hit_id long, particle_id long, tx double, ty double, tz double, tpx double, tpy double, tpz double, weight double",
}


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header under a given schema: no pass over the data to guess types; lines that do not fit raise."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def standard_hits(hits: DataFrame, cells: DataFrame, particles: DataFrame, truth: DataFrame, least_pt: float = 1.5) -> DataFrame:
    """Hits of particles whose transverse momentum is above least_pt, with the summed value of their cells.

    Hits without cells have energy 0. All four tables may hold many events if each has the column event_id.
    """
    event = ["event_id"] if "event_id" in hits.columns else []
    fast = particles.where(F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py")) > least_pt)
    chosen = truth.join(fast.select(*event, "particle_id"), [*event, "particle_id"], "left_semi").select(*event, "hit_id", "particle_id")
    energy = cells.groupBy(*event, "hit_id").agg(F.sum("value").alias("energy"))
    rows = hits.join(chosen, [*event, "hit_id"]).join(energy, [*event, "hit_id"], "left")
    return rows.withColumn("energy", F.coalesce("energy", F.lit(0.0)))
