"""Queries on the matched frame by several axes, condensation losses among neighbours, separations, and scans of four files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.functions.columns import c
from hitloom.operators import knn as kn
from hitloom.operators import matching as ma
from hitloom.operators import select as sel
from hitloom.plans.clusters import ASSIGNED_PAIRS, FRAME, TRUTH
from hitloom.plans.metrics import ALPHA, D2_SQL, Q, bin_of, cases, charged, d2
from hitloom.plans.objects import IOU, predicted
from hitloom.plans.registry import K, on_edges, on_hits, query, r
from hitloom.session import removed, shared_dir
from hitloom.sources import csv
from hitloom.sources.tables import Tables

KEY, OBJECT = ["event_id", "hit_id"], ["event_id", "t_idx"]
PHITS = "phits AS (SELECT *, CAST(floor(x/17) AS INTEGER) AS pred FROM hits)"
FRAMES = (IOU, ASSIGNED_PAIRS, TRUTH, PHITS, FRAME)

# Axes of the true object, with the edges of their bins.
AXES = {"energy": [0, 50, 100, 150, 200, 300, 400, 600, 1000], "pt": [0, 10, 20, 40, 60, 100, 200, 400], "eta": [0, 0.25, 0.5, 0.75, 1, 1.5, 2, 3], "local": [0, 0.2, 0.4, 0.6, 0.8, 0.95, 1.01]}
NEAR = 0.5
SHAPES = f"""place AS (SELECT event_id, t_idx, sum(energy) AS e, avg(x)/10-2.5 AS eta, avg(y)/10-2.5 AS phi FROM hits WHERE t_idx >= 0 GROUP BY 1, 2),
  around AS (SELECT a.event_id, a.t_idx, sum(b.e) AS near FROM place a JOIN place b ON a.event_id = b.event_id AND (a.eta-b.eta)*(a.eta-b.eta)+(a.phi-b.phi)*(a.phi-b.phi) <= {NEAR * NEAR} GROUP BY 1, 2),
  axes AS (SELECT event_id, t_idx, e AS energy, e/((exp(eta)+exp(-eta))/2) AS pt, abs(eta) AS eta, e/near AS local FROM place JOIN around USING (event_id, t_idx))"""


def true_axes(hits: DataFrame) -> DataFrame:
    """Each true object's energy, transverse momentum, absolute direction and share of the energy around it; pairs by cells."""
    place = hits.where("t_idx >= 0").groupBy(*OBJECT).agg(F.sum("energy").alias("e"), (F.avg("x") / 10 - 2.5).alias("eta"), (F.avg("y") / 10 - 2.5).alias("phi"))
    pairs = kn.close(place.withColumnRenamed("t_idx", "hit_id"), NEAR, ("eta", "phi", "e"), ("eta", "phi"))
    dx, dy = F.col("p_eta") - F.col("n_eta"), F.col("p_phi") - F.col("n_phi")
    pairs = pairs.where(dx * dx + dy * dy <= NEAR * NEAR)
    both = pairs.select("event_id", F.col("hit_id").alias("t_idx"), F.col("n_e").alias("o")).unionByName(pairs.select("event_id", F.col("nbr_id").alias("t_idx"), F.col("p_e").alias("o")))
    around = both.unionByName(place.select(*OBJECT, F.col("e").alias("o"))).groupBy(*OBJECT).agg(F.sum("o").alias("near"))
    e, eta = F.col("e"), F.col("eta")
    return place.join(around, OBJECT).select(*OBJECT, e.alias("energy"), (e / ((F.exp(eta) + F.exp(-eta)) / 2)).alias("pt"), F.abs(eta).alias("eta"), (e / F.col("near")).alias("local"))


@query(on_hits("SELECT axis, bin, count(*) AS n, round(avg(CASE WHEN pred IS NULL THEN 0.0 ELSE 1 END), 6) AS efficiency, round(avg(pred_energy/t_energy), 5) AS response FROM ("
  + " UNION ALL ".join(f"SELECT '{a}' AS axis, {cases('axes.' + a, edges, False)} AS bin, pred, pred_energy, t_energy FROM frame JOIN axes USING (event_id, t_idx)" for a, edges in AXES.items()) + ") WHERE bin IS NOT NULL GROUP BY 1, 2", *FRAMES, SHAPES))
def analyse_axes(t: Tables) -> DataFrame:
    """Efficiency and response of true objects by energy, transverse momentum, direction and local energy fraction."""
    frame = ma.frame(predicted(t), "energy", 0.1).where("t_idx is not null").select(*OBJECT, "pred", "pred_energy", "t_energy")
    rows = frame.join(true_axes(t.hits()), OBJECT)
    bins = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), bin_of(F.col(a), edges, False).alias("bin")) for a, edges in AXES.items())))
    rows = rows.select("pred", "pred_energy", "t_energy", bins.alias("b")).where("b.bin is not null")
    return rows.groupBy("b.axis", "b.bin").agg(F.count("*").alias("n"), r(F.avg(F.when(F.col("pred").isNull(), 0.0).otherwise(1.0))).alias("efficiency"), r(F.avg(F.col("pred_energy") / F.col("t_energy")), 5).alias("response"))


@query(on_hits("""SELECT band, bin, count(*) AS n, round(avg(CASE WHEN pred IS NULL THEN 0.0 ELSE 1 END), 6) AS efficiency FROM (SELECT CASE WHEN o.n < 4 THEN 0 WHEN o.n < 10 THEN 1 ELSE 2 END AS band, CAST(floor(least(t_energy/50, 10.99)) AS BIGINT) AS bin, pred
  FROM frame JOIN (SELECT event_id, t_idx, count(*) AS n FROM hits WHERE t_idx >= 0 GROUP BY 1, 2) o USING (event_id, t_idx)) GROUP BY 1, 2""", *FRAMES))
def track_efficiency(t: Tables) -> DataFrame:
    """Share of true objects that are matched, by momentum, clipped at the last bin, in bands of their number of rows."""
    n = t.hits().where("t_idx >= 0").groupBy(*OBJECT).agg(F.count("*").alias("rows"))
    o = ma.frame(predicted(t), "energy", 0.1).where("t_idx is not null").join(n, OBJECT)
    band = F.when(F.col("rows") < 4, 0).when(F.col("rows") < 10, 1).otherwise(2)
    return o.groupBy(band.alias("band"), F.floor(F.least(F.col("t_energy") / 50, F.lit(10.99))).alias("bin")).agg(F.count("*").alias("n"), r(F.avg(F.when(F.col("pred").isNull(), 0.0).otherwise(1.0))).alias("efficiency"))


# Objects further apart than this angle (radians) do not absorb each other's energy.
ANGLE = 0.2
CENTRES = """tc AS (SELECT event_id, t_idx, avg(x) AS tx, avg(y) AS ty, avg(z)+1 AS tz FROM hits WHERE t_idx >= 0 GROUP BY 1, 2), pc AS (SELECT event_id, pred, avg(x) AS px, avg(y) AS py, avg(z)+1 AS pz FROM phits GROUP BY 1, 2)"""


@query(on_hits(f"""SELECT count(*) AS objects, round(sum(CASE WHEN pred IS NOT NULL AND acos(least(1, (tx*px+ty*py+tz*pz)/(sqrt(tx*tx+ty*ty+tz*tz)*sqrt(px*px+py*py+pz*pz)))) <= {ANGLE} THEN least(greatest(pred_energy, 0), t_energy) ELSE 0 END)/sum(t_energy), 6) AS absorption
  FROM frame f JOIN tc USING (event_id, t_idx) LEFT JOIN pc USING (event_id, pred)""", *FRAMES, CENTRES))
def absorption(t: Tables) -> DataFrame:
    """Share of the true energy that the matched predicted objects take up, as far as both point the same way."""
    hits = predicted(t)

    def centre(key: str, side: str) -> DataFrame:
        return hits.where(F.col(key) >= 0).groupBy("event_id", key).agg(F.avg("x").alias(f"{side}x"), F.avg("y").alias(f"{side}y"), (F.avg("z") + 1).alias(f"{side}z"))

    frame = ma.frame(hits, "energy", 0.1).where("t_idx is not null")
    rows = frame.join(centre("t_idx", "t"), OBJECT).join(centre("pred", "p"), ["event_id", "pred"], "left")
    near = ma.angle(["tx", "ty", "tz"], ["px", "py", "pz"]) <= ANGLE
    taken = F.when(F.col("pred").isNotNull() & near, F.least(F.greatest("pred_energy", F.lit(0.0)), F.col("t_energy"))).otherwise(0.0)
    return rows.agg(F.count("*").alias("objects"), r(F.sum(taken) / F.sum("t_energy")).alias("absorption"))


# Fixed values of the losses among neighbours: widths of repulsion and of the well, least charge, and the share of the score's part.
REP_WIDTH, WELL, LEAST_CHARGE, PURE, SCORE_PART = 0.6, 0.5, 0.5, 0.5, 0.5
NEAR_ROWS = f"""nr AS (SELECT e.event_id, e.hit_id, slot, dsq/((4+40*a.tax)*(4+40*a.tax)+1e-4) AS s, CASE WHEN a.t_idx = b.t_idx AND b.t_idx >= 0 THEN 1.0::DOUBLE ELSE 0 END AS same, a.beta AS ab, b.beta AS bb, a.t_idx
  FROM edges e JOIN hits a USING (event_id, hit_id) JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id)"""


def near_rows(t: Tables) -> DataFrame:
    """Edges, self included, with squared distances in units of the row's own width; n counts those of the row."""
    e = kn.exploded(kn.lists(t.hits(), K, carry=("t_idx", "beta", "tax")), "t_idx", "beta", "tax", F.size("near").alias("n"))
    width = 4 + 40 * F.col("tax")
    same = F.when((F.col("t_idx") == F.col("n_t_idx")) & (F.col("n_t_idx") >= 0), 1.0).otherwise(0.0)
    return e.select(*KEY, "slot", (F.col("dsq") / (width * width + 1e-4)).alias("s"), same.alias("same"), F.col("beta").alias("ab"), F.col("n_beta").alias("bb"), "t_idx", "n")


@query(on_edges(f"""SELECT event_id, round({SCORE_PART}*avg(CASE WHEN purity > {PURE} THEN -ln(b) ELSE -ln(1-b) END) + {1 - SCORE_PART}*(avg(att+1e-3)+avg(rep+1e-3)), 5) AS loss, round(avg(CASE WHEN purity > {PURE} THEN 1.0 ELSE 0 END), 6) AS pure
  FROM (SELECT event_id, hit_id, least(greatest(max(ab), 1e-7), 1-1e-7) AS b, coalesce(sum(p*same)/(sum(p)+1e-3), 0) AS purity, coalesce(sum(CASE WHEN slot > 0 THEN same*s ELSE 0 END)/nullif(count(*)-1, 0), 0) AS att, coalesce(sum(CASE WHEN slot > 0 THEN (1-same)*p ELSE 0 END)/nullif(count(*)-1, 0), 0) AS rep
  FROM (SELECT *, exp(-s/(2*{REP_WIDTH}*{REP_WIDTH})) AS p FROM nr) GROUP BY 1, 2) GROUP BY 1""", NEAR_ROWS))
def knn_simple_condensation(t: Tables) -> DataFrame:
    """Neighbours of one object attract by distance, others repel; a row's score is to say whether its surroundings are of its object."""
    p, same, s, other = F.exp(-F.col("s") / (2 * REP_WIDTH * REP_WIDTH)), F.col("same"), F.col("s"), F.col("slot") > 0
    mean = lambda x: F.coalesce(F.try_divide(F.sum(F.when(other, x).otherwise(0.0)), F.count("*") - 1), F.lit(0.0))
    row = near_rows(t).groupBy(*KEY).agg(F.least(F.greatest(F.max("ab"), F.lit(1e-7)), F.lit(1 - 1e-7)).alias("b"), (F.sum(p * same) / (F.sum(p) + 1e-3)).alias("purity"), mean(same * s).alias("att"), mean((1 - same) * p).alias("rep"))
    pure = F.col("purity") > PURE
    score = F.avg(F.when(pure, -F.log("b")).otherwise(-F.log(1 - F.col("b"))))
    loss = SCORE_PART * score + (1 - SCORE_PART) * (F.avg(F.col("att") + 1e-3) + F.avg(F.col("rep") + 1e-3))
    return row.groupBy("event_id").agg(r(loss, 5).alias("loss"), r(F.avg(F.when(pure, 1.0).otherwise(0.0))).alias("pure"))


@query(on_edges(f"""SELECT event_id, round(avg(att+1e-3), 6) AS attraction, round(avg(rep+1e-3), 5) AS repulsion, round(sum(CASE WHEN t_idx < 0 THEN b ELSE 0 END)/(sum(CASE WHEN t_idx < 0 THEN 1 ELSE 0 END)+1e-3), 6) AS noise
  FROM (SELECT event_id, hit_id, max(ab) AS b, max(t_idx) AS t_idx, coalesce(sum(CASE WHEN slot > 0 THEN -same*(ab+{LEAST_CHARGE})*(bb+{LEAST_CHARGE})*exp(-s/(2*{WELL}*{WELL})) ELSE 0 END)/nullif(count(*)-1, 0), 0) AS att,
  coalesce(sum(CASE WHEN slot > 0 THEN (1-same)*(pow(atanh(ab/1.002), 2)+{LEAST_CHARGE})*(pow(atanh(bb/1.002), 2)+{LEAST_CHARGE})*exp(-s/2) ELSE 0 END)/nullif(count(*)-1, 0), 0) AS rep FROM nr GROUP BY 1, 2) GROUP BY 1""", NEAR_ROWS))
def knn_push_pull_condensation(t: Tables) -> DataFrame:
    """Neighbours of one object pull by their scores, in a well of two exponentials; others push by their charges; noise pays for its score."""

    def charge(beta: str) -> Column:
        a = F.atanh(F.col(beta) / 1.002)
        return a * a + LEAST_CHARGE

    same, s, other = F.col("same"), F.col("s"), F.col("slot") > 0
    pull = -same * (F.col("ab") + LEAST_CHARGE) * (F.col("bb") + LEAST_CHARGE) * F.exp(-s / (2 * WELL * WELL))
    push = (1 - same) * charge("ab") * charge("bb") * F.exp(-s / 2)
    # Each edge brings its share of its row's mean, and the edge to self its row, so that events are summed at once.
    rows = F.count_if(~other)
    mean = lambda x: F.sum(F.when(other, x / (F.col("n") - 1)).otherwise(0.0)) / rows + 1e-3
    noise = ~other & (F.col("t_idx") < 0)
    paid = F.sum(F.when(noise, F.col("ab")).otherwise(0.0)) / (F.count_if(noise) + 1e-3)
    return near_rows(t).groupBy("event_id").agg(r(mean(pull)).alias("attraction"), r(mean(push), 5).alias("repulsion"), r(paid).alias("noise"))


SEPARATED = f"least(sqrt({D2_SQL})/(abs(tax)+1e-3), 6)"


@query(on_hits(f"""SELECT same, cls, round(avg(v), 5) AS mean, count(*) AS n FROM (SELECT true AS same, cls, {SEPARATED} AS v FROM q JOIN al USING (event_id, t_idx)
  UNION ALL SELECT false, cls, v FROM (SELECT q.cls, {SEPARATED} AS v, row_number() OVER (PARTITION BY q.event_id, al.t_idx ORDER BY md5('5-' || q.event_id || '-' || q.hit_id), q.hit_id) AS place, size FROM q JOIN al ON al.event_id = q.event_id AND al.t_idx <> q.t_idx
  JOIN (SELECT event_id, t_idx, count(*) AS size FROM hits GROUP BY 1, 2) s ON s.event_id = al.event_id AND s.t_idx = al.t_idx) WHERE place <= size) GROUP BY 1, 2""", Q, ALPHA))
def cluster_separation(t: Tables) -> DataFrame:
    """Distances to an object's strongest row in units of a scale: of its own rows, and of a seeded sample of as many others.

    Rows of an event have places in a seeded order. Among the first 2 n of them at least n are not of an object of n rows, if
    the event has so many; so an object meets 2 n rows and not its event.
    """
    hits, alpha = charged(t)
    size = hits.groupBy(*OBJECT).agg(F.count("*").alias("size"))
    order = Window.partitionBy("event_id").orderBy("seeded", "hit_id")
    placed = hits.withColumn("seeded", sel.seeded(5, *KEY)).withColumn("at", F.row_number().over(order)).withColumnRenamed("t_idx", "own")
    objects = alpha.join(size, OBJECT)
    met = placed.join(objects, (placed["event_id"] == objects["event_id"]) & (F.col("at") <= 2 * F.col("size"))).where("own <> t_idx")
    rank = F.row_number().over(Window.partitionBy(objects["event_id"], "t_idx").orderBy("at"))
    value = F.least(F.sqrt(d2()) / (F.abs("tax") + 1e-3), F.lit(6.0)).alias("v")
    others = met.withColumn("place", rank).where("place <= size").select(F.lit(False).alias("same"), "cls", value)
    mine = hits.join(alpha, OBJECT).select(F.lit(True).alias("same"), "cls", value)
    return mine.unionByName(others).groupBy("same", "cls").agg(r(F.avg("v"), 5).alias("mean"), F.count("*").alias("n"))


@query("""WITH cells AS (SELECT l_orderkey AS hit_id, sum(l_extendedprice) AS energy FROM lineitem GROUP BY 1), fast AS (SELECT c_custkey AS particle_id, c_nationkey AS q FROM customer WHERE sqrt(pow(c_acctbal/1000, 2) + pow(c_nationkey/10, 2)) > 1.5)
  SELECT q, count(*) AS hits, count(DISTINCT o_custkey) AS particles, round(sum(coalesce(energy, 0)), 2) AS energy, round(avg(sqrt(pow(o_totalprice/1000, 2) + pow(o_custkey/100, 2) + pow(length(o_orderpriority) + 1, 2))), 5) AS radius
  FROM orders JOIN fast ON particle_id = o_custkey LEFT JOIN cells ON hit_id = o_orderkey GROUP BY 1""")
def tracking_scan(t: Tables) -> DataFrame:
    """Hits, cells, particles and truth written as four CSV files of whole tables, scanned under their schemas, joined, and summed by particle charge."""
    path = f"{shared_dir(t.spark)}/tracking-{uuid.uuid4().hex}"
    orders, customers, items = t.table("orders"), t.table("customer"), t.table("lineitem")
    zero, none = F.lit(0.0), F.lit(0)
    made = {
        "hits": orders.select(F.col("o_orderkey").alias("hit_id"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") / 100).alias("y"), (F.length("o_orderpriority") + 1.0).alias("z"), none.alias("volume_id"), none.alias("layer_id"), none.alias("module_id")),
        "cells": items.select(F.col("l_orderkey").alias("hit_id"), F.col("l_linenumber").alias("ch0"), none.alias("ch1"), F.col("l_extendedprice").alias("value")),
        "particles": customers.select(F.col("c_custkey").alias("particle_id"), *(zero.alias(v) for v in ("vx", "vy", "vz")), (F.col("c_acctbal") / 1000).alias("px"), (F.col("c_nationkey") / 10).alias("py"), zero.alias("pz"), F.col("c_nationkey").alias("q"), none.alias("nhits")),
        "truth": orders.select(F.col("o_orderkey").alias("hit_id"), F.col("o_custkey").alias("particle_id"), *(zero.alias(v) for v in ("tx", "ty", "tz", "tpx", "tpy", "tpz", "weight"))),
    }
    for name, rows in made.items():
        rows.write.option("header", True).csv(f"{path}/{name}")
    read = {name: csv.scan(t.spark, f"{path}/{name}", csv.SCHEMAS[name]) for name in made}
    hits = csv.standard_hits(read["hits"], read["cells"], read["particles"], read["truth"])
    radius = F.sqrt(c.x * c.x + c.y * c.y + F.col("z") * F.col("z"))
    told = hits.join(read["particles"].select("particle_id", "q"), "particle_id").groupBy("q").agg(F.count("*").alias("hits"), F.count_distinct("particle_id").alias("particles"), r(F.sum("energy"), 2).alias("energy"), r(F.avg(radius), 5).alias("radius"))
    # A row a charge goes through the driver, so that the files can go.
    told = t.spark.createDataFrame(told.collect(), told.schema)
    removed(t.spark, path)
    return told
