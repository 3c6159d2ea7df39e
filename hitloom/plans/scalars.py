"""Queries of scalar functions, filters and binning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitloom.functions import scalar as S
from hitloom.operators import select as sel
from hitloom.functions.columns import c
from hitloom.plans.registry import on_hits, query, r
from hitloom.sources.tables import Tables

KEY = ["event_id", "hit_id"]


@query(on_hits("""SELECT event_id, hit_id, round(sqrt(x*x+y*y+z*z), 6) AS radius, round(acos(z/sqrt(x*x+y*y+z*z)), 6) AS theta,
  round(CASE WHEN acos(z/sqrt(x*x+y*y+z*z)) > 0 THEN -ln(tan(acos(z/sqrt(x*x+y*y+z*z))/2)) END, 6) AS eta FROM hits"""))
def spherical(t: Tables) -> DataFrame:
    return t.hits().select(*KEY, r(S.radius(c.x, c.y, c.z)).alias("radius"), r(S.theta(c.x, c.y, c.z)).alias("theta"), r(S.eta_of_theta(S.theta(c.x, c.y, c.z))).alias("eta"))


@query(on_hits("""SELECT event_id, hit_id, round(-sign(z-20)*ln(sqrt(x*x+y*y)/abs(z-20+1e-3)/2+1e-3), 6) AS eta, round(atan2(y-25, x-25), 6) AS phi FROM hits"""))
def eta_phi(t: Tables) -> DataFrame:
    return t.hits().select(*KEY, r(S.eta(c.x, c.y, c.z - 20)).alias("eta"), r(S.phi(c.x - 25, c.y - 25)).alias("phi"))


@query(on_hits("""SELECT event_id, hit_id, round(CASE WHEN d > pi() THEN d - 2*pi() WHEN d <= -pi() THEN d + 2*pi() ELSE d END, 6) AS delta_phi,
  round((x-y)*(x-y)/100 + pow(CASE WHEN d > pi() THEN d - 2*pi() WHEN d <= -pi() THEN d + 2*pi() ELSE d END, 2), 6) AS delta_r2
  FROM (SELECT *, atan2(y-25, x-25) - atan2(z-20, y-25) AS d FROM hits)"""))
def delta_phi_wrapped(t: Tables) -> DataFrame:
    a, b = S.phi(c.x - 25, c.y - 25), S.phi(c.y - 25, c.z - 20)
    return t.hits().select(*KEY, r(S.delta_phi(a, b)).alias("delta_phi"), r(S.delta_r_squared(c.x / 10, a, c.y / 10, b)).alias("delta_r2"))


@query(on_hits("""SELECT event_id, hit_id, round(CASE WHEN z <> 0 THEN x/(10*z) ELSE 0 END, 9) AS px, round(CASE WHEN z <> 0 THEN y/(10*z) ELSE 0 END, 9) AS py,
  round(sqrt(x*x+y*y+z*z+1e-2)/100, 9) AS pr FROM hits"""))
def primed_coordinates(t: Tables) -> DataFrame:
    return t.hits().select(
        *KEY, *(r(F.coalesce(F.try_divide(v, 10 * c.z), F.lit(0.0)), 9).alias(n) for n, v in (("px", c.x), ("py", c.y))), r(F.sqrt(c.x * c.x + c.y * c.y + c.z * c.z + 1e-2) / 100, 9).alias("pr")
    )


@query(on_hits("""SELECT event_id, hit_id, round(cos(p)*rr, 5) AS cx, round(sin(p)*rr, 5) AS cy, round(abs(z-20), 5) AS ce
  FROM (SELECT *, atan2(y-25, x-25) AS p, sqrt(x*x+y*y) AS rr FROM hits)"""))
def manual_coordinates(t: Tables) -> DataFrame:
    p, rr = S.phi(c.x - 25, c.y - 25), F.sqrt(c.x * c.x + c.y * c.y)
    return t.hits().select(*KEY, r(F.cos(p) * rr, 5).alias("cx"), r(F.sin(p) * rr, 5).alias("cy"), r(F.abs(c.z - 20), 5).alias("ce"))


@query(on_hits("""SELECT event_id, hit_id, round(CASE WHEN is_track THEN (x-20)/(5+1e-8) ELSE (x-25)/(14+1e-8) END, 6) AS sx, round((energy-50)*0.02, 6) AS se FROM hits"""))
def standardised(t: Tables) -> DataFrame:
    """Means and widths by kind of hit, and an affine normalisation."""
    return t.hits().select(*KEY, r(F.when(F.col("is_track"), (c.x - 20) / (5 + 1e-8)).otherwise((c.x - 25) / (14 + 1e-8))).alias("sx"), r((c.energy - 50) * 0.02).alias("se"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, pdg, charge, CASE WHEN pdg = 0 THEN 'amb' WHEN pdg = 22 THEN 'gamma' WHEN abs(pdg) = 13 THEN 'muon'
  WHEN abs(pdg) = 11 THEN 'elec' WHEN charge <> 0 THEN 'chad' ELSE 'nhad' END AS pid
  FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey % 27 - 13 + CASE WHEN l_suppkey % 7 = 0 THEN 22 - (l_partkey % 27 - 13) ELSE 0 END AS pdg, l_suppkey % 3 - 1 AS charge FROM lineitem)""")
def pid_classes(t: Tables) -> DataFrame:
    base = F.col("l_partkey") % 27 - 13
    rows = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_suppkey") % 7 == 0, F.lit(22)).otherwise(base).cast("long").alias("pdg"), (F.col("l_suppkey") % 3 - 1).alias("charge"))
    return rows.withColumn("pid", S.pid_class(F.col("pdg"), F.col("charge")))


@query(on_hits("""SELECT event_id, hit_id, CASE WHEN beta < 0.5 THEN 0 ELSE 1 END AS m, CASE WHEN beta < 0.5 THEN 1 ELSE 0 END AS inv,
  CASE WHEN is_track THEN round(x, 6) ELSE round(energy, 6) END AS mixed, round(abs(x-25), 6) AS size, CAST(sign(x-25) AS INTEGER) AS sgn FROM hits"""))
def masks(t: Tables) -> DataFrame:
    return t.hits().select(
        *KEY, S.threshold_mask(c.beta, 0.5).alias("m"), S.threshold_mask(c.beta, 0.5, True).alias("inv"), F.when(F.col("is_track"), r(c.x)).otherwise(r(c.energy)).alias("mixed"),
        r(F.abs(c.x - 25)).alias("size"), F.signum(c.x - 25).cast("int").alias("sgn"),
    )


@query(on_hits("""SELECT event_id, hit_id, round(least(1.0, greatest(0.0, (energy/5-0.5)/9.5)), 6) AS ew,
  round(CASE WHEN abs(x-25) <= 5 THEN (x-25)*(x-25) ELSE 25 + 10*(abs(x-25)-5) END, 6) AS hub, round(greatest(0.2*(x-25), -0.8*(x-25)), 6) AS pin,
  round(CASE WHEN x > 10 THEN 10 + ln(greatest(x, 10.0)-10+1) ELSE x END, 6) AS clip FROM hits"""))
def robust_losses(t: Tables) -> DataFrame:
    return t.hits().select(*KEY, r(S.energy_weight(c.energy / 5)).alias("ew"), r(S.huber(c.x - 25, 5.0)).alias("hub"), r(S.pinball(c.x - 25, 0.2)).alias("pin"), r(S.soft_clip(c.x, 10.0)).alias("clip"))


@query(on_hits("""SELECT event_id, hit_id, round(CASE WHEN u >= 0 THEN 1+4*(2/(1+exp(-u))-1) ELSE 1/(1+4*(2/(1+exp(u))-1)) END, 6) AS scale,
  round(0.5*(1-tanh(10/(0.5+1e-2)*(beta-0.5)))*energy, 6) AS off, round(CASE WHEN energy <= 3 THEN energy ELSE 3+ln(greatest(energy, 3.0))-ln(3) END, 6) AS axis,
  CASE WHEN beta > 0.7 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS spectator, round(CASE WHEN is_track THEN 1.1*x ELSE 1.1*energy END, 6) AS momentum,
  round(CASE WHEN abs(x-25)/8 > 3 THEN 3.01 ELSE abs(x-25)/8 END, 6) AS clamped, round(exp(-x*x/100), 6) AS bell FROM (SELECT *, (x-25)/10 AS u FROM hits)"""))
def soft_scales(t: Tables) -> DataFrame:
    a = F.abs(c.x - 25) / 8
    return t.hits().select(
        *KEY, r(S.bounded_scale((c.x - 25) / 10, 5.0)).alias("scale"), r(S.modulated(c.energy, c.beta, 0.5)).alias("off"), r(S.response_scale(c.energy)).alias("axis"),
        F.when(c.beta > 0.7, 0.9).otherwise(0.0).alias("spectator"), r(F.when(F.col("is_track"), 1.1 * c.x).otherwise(1.1 * c.energy)).alias("momentum"),
        r(F.when(a > 3, 3.01).otherwise(a)).alias("clamped"), r(F.exp(-c.x * c.x / 100)).alias("bell"),
    )


@query(on_hits("""SELECT event_id, round(m + 1e-3*ln(s), 6) AS smooth_max FROM (SELECT event_id, max(m) AS m, sum(exp((beta-m)/1e-3)) AS s
  FROM (SELECT *, max(beta) OVER (PARTITION BY event_id) AS m FROM hits) GROUP BY event_id)"""))
def smooth_max(t: Tables) -> DataFrame:
    """eps * logsumexp(x / eps) in its stable form."""
    rows = t.hits().withColumn("m", F.max("beta").over(Window.partitionBy("event_id")))
    return rows.groupBy("event_id").agg(r(F.max("m") + 1e-3 * F.log(F.sum(F.exp((c.beta - F.col("m")) / 1e-3)))).alias("smooth_max"))


@query(on_hits("""SELECT event_id, hit_id, CASE WHEN is_track THEN -1 ELSE t_idx END AS t_idx, round(CASE WHEN is_track THEN 0 ELSE energy END, 6) AS energy FROM hits WHERE energy > 2 AND NOT (cls = 'N' AND is_track)"""))
def tracks_as_noise(t: Tables) -> DataFrame:
    rows = t.hits().where((c.energy > 2) & ~((F.col("cls") == "N") & F.col("is_track")))
    return rows.select(*KEY, F.when(F.col("is_track"), -1).otherwise(F.col("t_idx")).alias("t_idx"), r(F.when(F.col("is_track"), 0.0).otherwise(c.energy)).alias("energy"))


@query(on_hits("""SELECT event_id, hit_id, round(beta, 6) AS beta FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY beta DESC, hit_id) AS rn FROM hits) WHERE beta >= 0.97 OR rn = 1"""))
def select_threshold_guarded(t: Tables) -> DataFrame:
    return sel.select_threshold(t.hits(), "beta", 0.97).select(*KEY, r("beta").alias("beta"))


@query(on_hits("""SELECT event_id, hit_id, round(1/(1+exp(-20*(beta-4.6/20-thr))), 6) AS weight FROM hits, (SELECT least(0.9, min(m)-1e-6) AS thr FROM (SELECT max(beta) AS m FROM hits GROUP BY event_id)) WHERE beta >= thr"""))
def select_threshold_soft(t: Tables) -> DataFrame:
    return sel.select_lowered(t.hits(), "beta", 0.9).select(*KEY, r("weight").alias("weight"))


@query(on_hits("""SELECT event_id, hit_id, CASE WHEN beta > 0.4 OR beta = m THEN hit_id ELSE f END AS new_id FROM (SELECT *, min(CASE WHEN beta = m THEN hit_id END) OVER (PARTITION BY event_id) AS f
  FROM (SELECT *, min(beta) OVER (PARTITION BY event_id) AS m FROM hits))"""))
def noise_filter_backgather(t: Tables) -> DataFrame:
    return sel.noise_filter(t.hits(), "beta", 0.4)[1]


@query(on_hits("""SELECT m.event_id, m.hit_id, round(h.energy, 6) AS energy FROM (SELECT event_id, hit_id, CASE WHEN beta > 0.4 OR beta = m THEN hit_id ELSE f END AS new_id FROM (SELECT *, min(CASE WHEN beta = m THEN hit_id END) OVER (PARTITION BY event_id) AS f
  FROM (SELECT *, min(beta) OVER (PARTITION BY event_id) AS m FROM hits))) m JOIN hits h ON h.event_id = m.event_id AND h.hit_id = m.new_id"""))
def back_gather(t: Tables) -> DataFrame:
    kept, mapping = sel.noise_filter(t.hits(), "beta", 0.4)
    return sel.back_gather(mapping, kept, "energy").select(*KEY, r("energy").alias("energy"))


@query(on_hits("""SELECT event_id, hit_id, CASE WHEN beta > 0.8 THEN round(energy, 6) ELSE 1.0 END AS corr, CASE WHEN beta > 0.8 THEN round(x, 6) ELSE 100.0 END AS ccoord FROM hits"""))
def back_scatter(t: Tables) -> DataFrame:
    """Values of selected rows at their own places, one default per column elsewhere."""
    top = t.hits().where(c.beta > 0.8).select(*KEY, r("energy").alias("corr"), r("x").alias("ccoord"))
    return sel.back_scatter(t.hits(), top, {"corr": 1.0, "ccoord": 100.0})


@query(on_hits("""SELECT h.event_id, h.hit_id FROM hits h JOIN (SELECT event_id, t_idx, avg(x) AS cx, avg(y) AS cy FROM hits WHERE t_idx >= 0 GROUP BY event_id, t_idx) c
  ON c.event_id = h.event_id WHERE (h.x-c.cx)*(h.x-c.cx)+(h.y-c.cy)*(h.y-c.cy) < 64 GROUP BY h.event_id, h.hit_id"""))
def cone_selection(t: Tables) -> DataFrame:
    """Hits in a cone around the centre of any object of their event: a semi-join, so no hit is repeated."""
    hits = t.hits()
    centres = hits.where("t_idx >= 0").groupBy("event_id", "t_idx").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).withColumnRenamed("event_id", "ev")
    near = (F.col("event_id") == F.col("ev")) & ((c.x - F.col("cx")) * (c.x - F.col("cx")) + (c.y - F.col("cy")) * (c.y - F.col("cy")) < 64)
    return hits.join(centres, near, "left_semi").select(*KEY)


@query(on_hits("""SELECT event_id, hit_id, bx, by_ AS by, (bx * 1000 + by_) AS cell, count(*) OVER (PARTITION BY event_id, bx, by_) AS n
  FROM (SELECT h.event_id, h.hit_id, CAST(floor((x-x0)/w) AS BIGINT) AS bx, CAST(floor((y-y0)/w) AS BIGINT) AS by_
  FROM hits h, (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x)-min(x), max(y)-min(y))/8+1e-3 AS w FROM hits))"""))
def bin_by_coordinates(t: Tables) -> DataFrame:
    """Cells of one width for all dimensions, shifted by the least coordinates of all events; rows per cell."""
    hits = t.hits()
    w = hits.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) / 8 + 1e-3).alias("w"))
    rows = hits.crossJoin(F.broadcast(w)).select(*KEY, F.floor((c.x - F.col("x0")) / F.col("w")).alias("bx"), F.floor((c.y - F.col("y0")) / F.col("w")).alias("by"))
    return rows.withColumn("cell", F.col("bx") * 1000 + F.col("by")).withColumn("n", F.count("*").over(Window.partitionBy("event_id", "bx", "by")))


LATENT = """grid AS (SELECT *, CAST(floor((x-x0)/((x1-x0)/nx*1.00001)) AS BIGINT) AS cx, CAST(floor((y-y0)/((y1-y0)/ny*1.00001)) AS BIGINT) AS cy
  FROM (SELECT *, greatest(3, CAST(floor((x1-x0)/6) AS BIGINT)) AS nx, greatest(3, CAST(floor((y1-y0)/6) AS BIGINT)) AS ny
  FROM (SELECT *, min(x) OVER w AS x0, max(x) OVER w + 1e-3 AS x1, min(y) OVER w AS y0, max(y) OVER w + 1e-3 AS y1 FROM hits WINDOW w AS (PARTITION BY event_id))))"""


def latent(hits: DataFrame, size: float = 6.0, least: int = 3) -> DataFrame:
    """Cells of each event's own grid: at least `least` a dimension, about `size` wide."""
    w = Window.partitionBy("event_id")
    for d in ("x", "y"):
        hits = hits.withColumn(f"{d}0", F.min(d).over(w)).withColumn(f"{d}1", F.max(d).over(w) + 1e-3)
        n = F.greatest(F.lit(least), F.floor((F.col(f"{d}1") - F.col(f"{d}0")) / size))
        hits = hits.withColumn(f"c{d}", F.floor((F.col(d) - F.col(f"{d}0")) / ((F.col(f"{d}1") - F.col(f"{d}0")) / n * 1.00001)))
    return hits


@query(on_hits("SELECT event_id, cx, cy, count(*) AS n, round(sum(energy), 5) AS energy FROM grid GROUP BY event_id, cx, cy", LATENT))
def latent_grid(t: Tables) -> DataFrame:
    return latent(t.hits()).groupBy("event_id", "cx", "cy").agg(F.count("*").alias("n"), r(F.sum("energy"), 5).alias("energy"))


@query(on_hits("SELECT event_id, hit_id, round(max(energy) OVER (PARTITION BY event_id, cx, cy), 6) AS pooled FROM grid", LATENT))
def grid_max_pool(t: Tables) -> DataFrame:
    return latent(t.hits()).select(*KEY, r(F.max("energy").over(Window.partitionBy("event_id", "cx", "cy"))).alias("pooled"))


@query(on_hits("""SELECT event_id*2 + CASE WHEN z >= 20 THEN 1 ELSE 0 END AS endcap, count(*) AS n, round(sum(energy), 5) AS energy FROM hits GROUP BY 1"""))
def endcap_split(t: Tables) -> DataFrame:
    return t.hits().groupBy((F.col("event_id") * 2 + (c.z >= 20).cast("int")).alias("endcap")).agg(F.count("*").alias("n"), r(F.sum("energy"), 5).alias("energy"))


@query(on_hits("""SELECT event_id, src, rank AS hit_id, round(e, 6) AS energy FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY src, hit_id) AS rank
  FROM (SELECT event_id, 0 AS src, hit_id, energy AS e FROM hits WHERE NOT is_track UNION ALL SELECT event_id, 1, hit_id, x FROM hits WHERE is_track))"""))
def concat_collections(t: Tables) -> DataFrame:
    """Hits, then tracks, of each event in one collection with new row numbers."""
    hits = t.hits()
    a = hits.where(~F.col("is_track")).select("event_id", F.lit(0).alias("src"), "hit_id", c.energy.alias("e"))
    b = hits.where("is_track").select("event_id", F.lit(1).alias("src"), "hit_id", c.x.alias("e"))
    w = Window.partitionBy("event_id").orderBy("src", "hit_id")
    return a.unionByName(b).withColumn("rank", F.row_number().over(w).cast("long")).select("event_id", "src", F.col("rank").alias("hit_id"), r("e").alias("energy"))


@query("SELECT vec_id, i AS pos, CAST(embedding[i+1] AS DOUBLE) AS v FROM embeddings, unnest(range(0, len(embedding))) AS u(i)")
def jagged_flatten(t: Tables) -> DataFrame:
    """Arrays of rows as flat rows with their place in the array."""
    return t.table("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))


@query(on_hits("""SELECT event_id, hit_id, round(ln(energy+1+1e-8), 6) AS log_e, CASE WHEN cls = 'A' THEN 0 WHEN cls = 'N' THEN 1 ELSE 2 END AS pid, round(z, 6) AS z FROM hits"""))
def event_frame(t: Tables) -> DataFrame:
    """The export of events as flat frames."""
    return t.hits().select(*KEY, r(F.log(c.energy + 1 + 1e-8)).alias("log_e"), F.when(F.col("cls") == "A", 0).when(F.col("cls") == "N", 1).otherwise(2).alias("pid"), r("z").alias("z"))
