"""Queries of further metrics, losses, covariances and compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.functions.columns import c
from hitloom.operators import edges as ed
from hitloom.operators import knn as kn
from hitloom.operators import quantiles as qu
from hitloom.operators import select as sel
from hitloom.plans.graphs import DOWN, NB, SCALE, UP, down_edges, transition
from hitloom.plans.metrics import EDGES, Q, all_bins, bin_of, cases, charged, grid_sql
from hitloom.plans.objects import IOU, PAGE, predicted
from hitloom.operators import matching as ma
from hitloom.plans.registry import K, on_edges, on_hits, query, r
from hitloom.sources.tables import Tables, edges_sql

KEY = ["event_id", "hit_id"]


def edges(t: Tables, *carry: str) -> DataFrame:
    """Neighbour edges that carry columns of both ends."""
    return kn.knn(t.hits(), K, carry=carry)


def count_if(cond: str) -> str:
    return f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)"


@query(on_hits("SELECT event_id, hit_id, nbr_id, slot, round(dsq, 5) AS dsq FROM edges", edges_sql(K, "a.event_id = b.event_id AND NOT a.is_track")))
def knn_only_have(t: Tables) -> DataFrame:
    """Only rows that are no tracks ask; all can be found."""
    return kn.knn(t.hits(), K, probes=~F.col("is_track")).select(*KEY, "nbr_id", F.col("slot").cast("long").alias("slot"), r("dsq", 5).alias("dsq"))


@query(on_hits("SELECT event_id, hit_id, hit_id AS nbr_id, 0::BIGINT AS slot FROM hits"))
def knn_neither(t: Tables) -> DataFrame:
    """Rows that neither ask nor are found have themselves only."""
    e = kn.knn(t.hits(), K, neighbours=F.lit(False))
    return e.select(*KEY, "nbr_id", F.col("slot").cast("long").alias("slot"))


@query(on_edges(f"SELECT e.event_id, e.hit_id, round(sum(b.energy)/5, 5) AS mean, round(max(b.energy), 5) AS max, arg_max(b.hit_id, b.energy*1000000 - slot) AS argmax FROM {NB} GROUP BY 1, 2"))
def neighbour_average_max(t: Tables) -> DataFrame:
    """Mean and maximum of the neighbours without regard to distance, and where the maximum is."""
    e = ed.with_neighbour(edges(t, "energy"), t.hits(), "energy")
    x = F.col("n_energy")
    return e.groupBy(*KEY).agg(r(F.sum(x) / K, 5).alias("mean"), r(F.max(x), 5).alias("max"), F.max_by("nbr_id", x * 1000000 - F.col("slot")).alias("argmax"))


MEANS = f"mu AS (SELECT e.event_id, e.hit_id, sum(w*b.x)/(sum(w)+1e-3) AS mx, sum(w*b.y)/(sum(w)+1e-3) AS my FROM (SELECT *, exp(-dsq/50) AS q FROM edges) e JOIN (SELECT *, 1/(1+exp(-(energy/50)))+1e-3 AS s FROM hits) b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id, LATERAL (SELECT q*s AS w) GROUP BY 1, 2)"


@query(on_edges("""SELECT e.event_id, e.hit_id, round(sum(w*(b.x-m.mx)*(b.x-m.mx))/(sum(w)+1e-3), 4) AS xx, round(sum(w*(b.x-m.mx)*(b.y-m.my))/(sum(w)+1e-3), 4) AS xy, round(sum(w*(b.y-m.my)*(b.x-m.mx))/(sum(w)+1e-3), 4) AS yx, round(sum(w*(b.y-m.my)*(b.y-m.my))/(sum(w)+1e-3), 4) AS yy
  FROM edges e JOIN (SELECT *, 1/(1+exp(-(energy/50)))+1e-3 AS s FROM hits) b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id JOIN mu m ON m.event_id = e.event_id AND m.hit_id = e.nbr_id, LATERAL (SELECT exp(-dsq/50)*s AS w) GROUP BY 1, 2""", MEANS))
def composed_covariance(t: Tables) -> DataFrame:
    """All entries of the neighbours' covariance, each neighbour about its own mean."""
    hits = t.hits().withColumn("s", 1 / (1 + F.exp(-(c.energy / 50))) + 1e-3)
    cov = ed.composed_covariance(kn.knn(hits, K, carry=("s", "x", "y")), hits, "s", ("x", "y"), F.exp(-F.col("dsq") / 50))
    return cov.select(*KEY, *(r(p, 4).alias(p) for p in ("xx", "xy", "yx", "yy")))


OBJS = "o AS (SELECT event_id, t_idx, sum(energy) AS e, avg(x) AS cx, avg(y) AS cy FROM hits WHERE t_idx >= 0 GROUP BY 1, 2)"


@query(on_hits("SELECT a.event_id, a.t_idx, b.t_idx AS other, round((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy), 5) AS dr2 FROM o a JOIN o b ON a.event_id = b.event_id AND a.t_idx <> b.t_idx", OBJS))
def object_distances(t: Tables) -> DataFrame:
    """Squared distances of the objects of an event; events hold few objects."""
    o = t.hits().where("t_idx >= 0").groupBy("event_id", "t_idx").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    b = o.select("event_id", F.col("t_idx").alias("other"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    dx, dy = F.col("cx") - F.col("bx"), F.col("cy") - F.col("by")
    return o.join(b, "event_id").where("t_idx <> other").select("event_id", "t_idx", "other", r(dx * dx + dy * dy, 5).alias("dr2"))


@query(on_hits("SELECT event_id, hit_id, round(x - avg(x) OVER w, 5) AS sub, round(x + avg(x) OVER w, 5) AS added, round(x * avg(x) OVER w, 4) AS mult, round(avg(x) OVER w, 5) AS concat FROM hits WHERE t_idx >= 0 WINDOW w AS (PARTITION BY event_id, t_idx)"))
def mix_modes(t: Tables) -> DataFrame:
    """A row's feature with its object's: less, plus, times and beside it."""
    m = F.avg("x").over(Window.partitionBy("event_id", "t_idx"))
    return t.hits().where("t_idx >= 0").select(*KEY, r(c.x - m, 5).alias("sub"), r(c.x + m, 5).alias("added"), r(c.x * m, 4).alias("mult"), r(m, 5).alias("concat"))


@query(on_hits("""SELECT event_id, t_idx, round(CASE WHEN bool_or(is_track AND hit_id = alpha) THEN max(CASE WHEN hit_id = alpha THEN x END) ELSE sum(CASE WHEN is_track THEN 0 ELSE energy*x END)/nullif(sum(CASE WHEN is_track THEN 0 ELSE energy END), 0) END, 5) AS x
  FROM (SELECT *, arg_max(hit_id, beta*1000000 - hit_id/1000.0) OVER (PARTITION BY event_id, t_idx) AS alpha FROM hits WHERE t_idx >= 0) GROUP BY 1, 2"""))
def object_truth_tracks(t: Tables) -> DataFrame:
    """Energy-weighted means of objects; those whose best row is a track take that row's value."""
    w = Window.partitionBy("event_id", "t_idx")
    rows = t.hits().where("t_idx >= 0").withColumn("alpha", F.max_by("hit_id", c.beta * 1000000 - F.col("hit_id") / 1000.0).over(w))
    own = F.col("hit_id") == F.col("alpha")
    e = F.when(F.col("is_track"), 0.0).otherwise(c.energy)
    value = F.when(F.bool_or(own & F.col("is_track")), F.max(F.when(own, c.x))).otherwise(F.try_divide(F.sum(e * c.x), F.sum(e)))
    return rows.groupBy("event_id", "t_idx").agg(r(value, 5).alias("x"))


@query(on_hits("""SELECT event_id, round(pow(sum(CASE WHEN first THEN te ELSE 0 END) - sum(CASE WHEN is_track THEN 0 ELSE energy END), 2)/pow(abs(sum(CASE WHEN first THEN te ELSE 0 END))+1e-6, 2), 6) AS balance
  FROM (SELECT *, sum(energy) OVER (PARTITION BY event_id, t_idx) AS te, row_number() OVER (PARTITION BY event_id, t_idx ORDER BY hit_id) = 1 AS first FROM hits WHERE t_idx >= 0 AND cls <> 'A') GROUP BY 1"""))
def event_balance_unique(t: Tables) -> DataFrame:
    """Energy balance of an event: each true object once, without one class, noise and tracks."""
    w = Window.partitionBy("event_id", "t_idx")
    rows = t.hits().where("t_idx >= 0 and cls <> 'A'").withColumn("te", F.sum("energy").over(w)).withColumn("first", F.row_number().over(w.orderBy("hit_id")) == 1)
    true = F.sum(F.when(F.col("first"), F.col("te")).otherwise(0.0))
    lost = true - F.sum(F.when(F.col("is_track"), 0.0).otherwise(c.energy))
    total = F.abs(true) + 1e-6
    return rows.groupBy("event_id").agg(r(lost * lost / (total * total)).alias("balance"))


@query(on_hits("SELECT event_id, t_idx, round(acos((cx*dx+cy*dy)/(sqrt(cx*cx+cy*cy)*sqrt(dx*dx+dy*dy))), 5) AS angle FROM (SELECT event_id, t_idx, sum(energy*x) AS cx, sum(energy*y) AS cy, sum(x) AS dx, sum(z) + 1 AS dy FROM hits WHERE t_idx >= 0 GROUP BY 1, 2)"))
def direction_angle(t: Tables) -> DataFrame:
    """The angle between two directions of an object."""
    o = t.hits().where("t_idx >= 0").groupBy("event_id", "t_idx").agg(F.sum(c.energy * c.x).alias("cx"), F.sum(c.energy * F.col("y")).alias("cy"), F.sum("x").alias("dx"), (F.sum("z") + 1).alias("dy"))
    return o.select("event_id", "t_idx", r(ma.angle(("cx", "cy"), ("dx", "dy")), 5).alias("angle"))


@query(on_hits("SELECT event_id, hit_id, round(energy*(1+tax), 5) AS energy, round(0.5*((tax+1)-(tax*2)), 6) AS unc, CASE WHEN x >= y AND x >= z THEN 0 WHEN y >= z THEN 1 ELSE 2 END AS pid FROM hits"))
def processed_predictions(t: Tables) -> DataFrame:
    """Predictions as the matching takes them: corrected energy, half the quantile width, the class of the highest score."""
    rows = t.hits().select(*KEY, c.energy, (1 + F.col("tax")).alias("corr"), (F.col("tax") * 2).alias("q_low"), (F.col("tax") + 1).alias("q_high"), F.array("x", "y", "z").alias("scores"))
    return ma.processed(rows).select(*KEY, r("energy", 5).alias("energy"), r("unc").alias("unc"), "pid")


@query(on_hits("SELECT event_id, t_idx, pred, round(iou, 6) AS iou FROM ious JOIN (SELECT event_id, t_idx, sum(energy) AS te FROM hits WHERE t_idx >= 0 GROUP BY 1, 2) USING (event_id, t_idx) JOIN (SELECT event_id, CAST(floor(x/17) AS INTEGER) AS pred, sum(energy) AS pe FROM hits GROUP BY 1, 2) USING (event_id, pred) WHERE iou >= 0.05 AND abs(te-pe)/te <= 0.9", IOU))
def overlap_energy_cut(t: Tables) -> DataFrame:
    """Overlaps of objects whose energies differ by a share at most."""
    hits = predicted(t)
    true = hits.where("t_idx >= 0").groupBy("event_id", "t_idx").agg(F.sum("energy").alias("te"))
    pred = hits.groupBy("event_id", "pred").agg(F.sum("energy").alias("pe"))
    o = ma.overlap(hits, "t_idx", "pred", "energy").where("iou >= 0.05").join(true, ["event_id", "t_idx"]).join(pred, ["event_id", "pred"])
    return o.where(F.abs(F.col("te") - F.col("pe")) / F.col("te") <= 0.9).select("event_id", "t_idx", "pred", r("iou").alias("iou"))


@query(on_hits(f"SELECT bin, round(sqrt(sum(w*pow(v-m, 2))/sum(w)), 6) AS rms, count(*) AS n FROM (SELECT *, avg(v) OVER (PARTITION BY bin) AS m FROM (SELECT CASE WHEN energy > 0 AND energy < 40 THEN 0 WHEN energy > 40 AND energy < 80 THEN 1 END AS bin, x/energy AS v, beta AS w FROM hits WHERE energy > 0)) WHERE bin IS NOT NULL GROUP BY 1"))
def resolution_weighted(t: Tables) -> DataFrame:
    """Weighted spread about the mean without weights, in open intervals."""
    b = F.when((c.energy > 0) & (c.energy < 40), 0).when((c.energy > 40) & (c.energy < 80), 1)
    rows = t.hits().where("energy > 0").select(b.alias("bin"), (c.x / c.energy).alias("v"), c.beta.alias("w")).where("bin is not null")
    # The weighted mean of (v - m)^2 with m the plain mean follows from sums, so no rows are kept.
    m, w, v = F.avg("v"), F.col("w"), F.col("v")
    rms = F.sqrt(F.sum(w * v * v) / F.sum("w") - 2 * m * F.sum(w * v) / F.sum("w") + m * m)
    return rows.groupBy("bin").agg(r(rms).alias("rms"), F.count("*").alias("n"))


@query(on_hits("SELECT bin, count(*) AS n, round(avg(x), 5) AS mean, round(quantile_cont(x, 0.5), 5) AS mid FROM (SELECT x, least(CAST(floor((energy - lo)/((hi-lo)/10)) AS BIGINT), 9) AS bin FROM hits, (SELECT min(energy) AS lo, max(energy) AS hi FROM hits)) GROUP BY 1"))
def profile_uniform(t: Tables) -> DataFrame:
    """Ten bins of equal width over the whole range."""
    hits = t.hits()
    ends = hits.agg(F.min("energy").alias("lo"), F.max("energy").alias("hi"))
    b = F.least(F.floor((c.energy - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 10)), F.lit(9))
    rows = hits.crossJoin(F.broadcast(ends)).select(b.alias("bin"), "x")  # one row is broadcast
    mid = qu.quantiles(rows, "x", [0.5], ["bin"]).select(F.col("bin").alias("b"), "quantile")
    n = rows.groupBy("bin").agg(F.count("*").alias("n"), r(F.avg("x"), 5).alias("mean"))
    return n.join(mid, F.col("bin").eqNullSafe(F.col("b"))).select("bin", "n", "mean", r("quantile", 5).alias("mid"))


@query(on_hits("SELECT bin, count(*) AS n, round(avg(x), 5) AS mean FROM (SELECT x, CASE WHEN energy <= q[1] THEN 0 WHEN energy <= q[2] THEN 1 WHEN energy <= q[3] THEN 2 ELSE 3 END AS bin FROM hits, (SELECT quantile_cont(energy, [0.25, 0.5, 0.75]) AS q FROM hits)) GROUP BY 1"))
def profile_percentiles(t: Tables) -> DataFrame:
    """Bins between quantiles, with equal numbers of rows."""
    hits = t.hits()
    q = qu.quantiles(hits, "energy", [0.25, 0.5, 0.75]).agg(F.collect_list("quantile").alias("q"))  # three values
    b = F.size(F.filter("q", lambda x: x < c.energy))
    return hits.crossJoin(F.broadcast(q)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), r(F.avg("x"), 5).alias("mean"))  # one row is broadcast


@query(on_hits(f"SELECT bin, round(n/((hi-lo)/200.0)/sum(n/((hi-lo)/200.0)) OVER (), 6) AS fraction FROM (SELECT {cases('energy', EDGES)} AS bin, count(*) AS n FROM hits GROUP BY 1) JOIN {grid_sql(EDGES)} g USING (bin)"))
def histogram_fraction(t: Tables) -> DataFrame:
    """Counts over the bins' share of the range, as fractions of their sum."""
    n = t.hits().groupBy(bin_of(c.energy, EDGES).alias("bin")).agg(F.count("*").alias("n"))
    rows = all_bins(n, EDGES, n).where("n is not null").withColumn("d", F.col("n") / ((F.col("hi") - F.col("lo")) / 200.0))
    return rows.select("bin", r(F.col("d") / F.sum("d").over(Window.partitionBy())).alias("fraction"))  # one row a bin


CURVES = """curves AS (SELECT pair, beta, sum(pos) OVER w/sum(pos) OVER (PARTITION BY pair) AS tpr, sum(neg) OVER w/sum(neg) OVER (PARTITION BY pair) AS fpr
  FROM (SELECT pair, beta, count(CASE WHEN cls = pair[1] THEN 1 END) AS pos, count(CASE WHEN cls = pair[2] THEN 1 END) AS neg FROM hits JOIN (SELECT unnest(['AR', 'AN', 'NR']) AS pair) ON cls = pair[1] OR cls = pair[2] GROUP BY 1, 2) WINDOW w AS (PARTITION BY pair ORDER BY beta DESC))"""


def curves(t: Tables) -> DataFrame:
    """Curves of every pair of classes over all distinct scores: pair, beta, tpr, fpr.

    Scores of a pair are counted in coarse bands first; windows order the scores of one band, and bands
    are summed apart, so no task orders all scores.
    """
    pairs = F.explode(F.filter(F.array(*map(F.lit, ("AR", "AN", "NR"))), lambda p: F.contains(p, F.col("cls"))))
    rows = t.hits().select("cls", "beta", pairs.alias("pair"))
    n = rows.groupBy("pair", "beta").agg(F.count_if(F.col("cls") == F.substring("pair", 1, 1)).alias("pos"), F.count_if(F.col("cls") == F.substring("pair", 2, 1)).alias("neg"))
    n = n.withColumn("band", F.floor(c.beta * 100))
    bands = n.groupBy("pair", "band").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    above = Window.partitionBy("pair").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("pair")
    before = bands.select("pair", "band", *(F.coalesce(F.sum(x).over(above), F.lit(0)).alias(f"{x}0") for x in "pq"), *(F.sum(x).over(whole).alias(f"{x}all") for x in "pq"))
    inner = Window.partitionBy("pair", "band").orderBy(F.desc("beta"))
    curve = n.withColumns({"cp": F.sum("pos").over(inner), "cq": F.sum("neg").over(inner)}).join(before, ["pair", "band"])
    return curve.select("pair", "beta", ((F.col("p0") + F.col("cp")) / F.col("pall")).alias("tpr"), ((F.col("q0") + F.col("cq")) / F.col("qall")).alias("fpr"))


@query(on_hits("SELECT round(beta, 6) AS score, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM curves WHERE pair = 'AR'", CURVES))
def roc_one_vs_one(t: Tables) -> DataFrame:
    """Rates of one class against another at every distinct score."""
    return curves(t).where("pair = 'AR'").select(r("beta").alias("score"), r("tpr").alias("tpr"), r("fpr").alias("fpr"))


@query(on_hits("SELECT pair, round(max(CASE WHEN fpr <= 0.1 THEN tpr END), 6) AS tpr_at, round(min(CASE WHEN tpr >= 0.9 THEN fpr END), 6) AS fpr_at, count(*) AS points FROM curves GROUP BY 1", CURVES))
def roc_lookup(t: Tables) -> DataFrame:
    """The curves, looked up at fixed rates."""
    return curves(t).groupBy("pair").agg(r(F.max(F.when(F.col("fpr") <= 0.1, F.col("tpr")))).alias("tpr_at"), r(F.min(F.when(F.col("tpr") >= 0.9, F.col("fpr")))).alias("fpr_at"), F.count("*").alias("points"))


@query(on_hits("SELECT bin, count(*) AS n, round((quantile_cont(v, 0.84) - quantile_cont(v, 0.16))/2, 6) AS half_width FROM (SELECT (energy-x)/energy AS v, CAST(floor(tax/0.01) AS BIGINT) AS bin FROM hits WHERE energy > 0 AND tax >= 0 AND tax < 0.3) GROUP BY 1"))
def resolution_estimator(t: Tables) -> DataFrame:
    """True relative deviations against their estimator: half the width between quantiles, 30 bins from 0 to 0.3."""
    rows = t.hits().where("energy > 0 and tax >= 0 and tax < 0.3").select(((c.energy - c.x) / c.energy).alias("v"), F.floor(F.col("tax") / 0.01).alias("bin"))
    q = qu.wide(qu.quantiles(rows, "v", [0.16, 0.84], ["bin"]), [0.16, 0.84], ["lo", "hi"], ["bin"])
    return rows.groupBy("bin").agg(F.count("*").alias("n")).join(q, "bin").select("bin", "n", r((F.col("hi") - F.col("lo")) / 2).alias("half_width"))


@query(on_hits("SELECT bin, round(avg(beta), 6) AS mean, count(*) AS n, round(stddev_pop(beta)/sqrt(count(*)), 6) AS error FROM (SELECT *, " + cases("energy", EDGES, False) + " AS bin FROM hits) WHERE bin IS NOT NULL GROUP BY 1"))
def binned_errors(t: Tables) -> DataFrame:
    """Binned means with their errors, kept wide and read back long."""
    rows = t.hits().withColumn("bin", bin_of(c.energy, EDGES, False)).where("bin is not null")
    n = rows.groupBy("bin").agg(F.avg("beta").alias("mean"), F.count("*").alias("n"), (F.stddev_pop("beta") / F.sqrt(F.count("*"))).alias("error"))
    names = ("mean", "n", "error")
    wide = n.groupBy().agg(*(F.max(F.when(F.col("bin") == b, F.col(x).cast("double"))).alias(f"{x}_{b}") for b in range(len(EDGES) - 1) for x in names))
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(b).alias("bin"), *(F.col(f"{x}_{b}").alias(x) for x in names)) for b in range(len(EDGES) - 1)))).alias("s")).select("s.*")
    return long.where("n is not null").select("bin", r("mean").alias("mean"), F.col("n").cast("long").alias("n"), r("error").alias("error"))


@query(on_hits("""SELECT 'x' AS what, CAST(floor(least(greatest(x, 5), 45)) AS BIGINT) AS bin, count(*) AS n FROM hits GROUP BY 2 UNION ALL SELECT 'object_energy', CAST(floor(least(e, 90)/10) AS BIGINT), count(*) FROM (SELECT arg_min(energy, hit_id) AS e FROM hits WHERE t_idx >= 0 GROUP BY event_id, t_idx) GROUP BY 2
  UNION ALL SELECT 'class', CASE WHEN cls IN ('A', 'R') THEN 0 ELSE 1 END, count(*) FROM (SELECT arg_min(cls, hit_id) AS cls FROM hits WHERE t_idx >= 0 GROUP BY event_id, t_idx) GROUP BY 2"""))
def dataset_overview(t: Tables) -> DataFrame:
    """Histograms of a dataset: a clipped coordinate, and of each object's first row its energy and merged class."""
    hits = t.hits()
    first = hits.where("t_idx >= 0").groupBy("event_id", "t_idx").agg(F.min_by(F.struct("energy", "cls"), "hit_id").alias("f")).select("f.*")

    def counted(rows: DataFrame, what: str, b: Column) -> DataFrame:
        return rows.groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "bin", "n")

    out = counted(hits, "x", F.floor(F.least(F.greatest(c.x, F.lit(5.0)), F.lit(45.0))))
    return out.unionByName(counted(first, "object_energy", F.floor(F.least(c.energy, F.lit(90.0)) / 10))).unionByName(counted(first, "class", F.when(F.col("cls").isin("A", "R"), 0).otherwise(1)))


LOST = "o AS (SELECT event_id, t_idx, sum(energy) AS e, count(*) AS n, count(CASE WHEN beta > 0.8 THEN 1 END) AS kept FROM hits WHERE t_idx >= 0 GROUP BY 1, 2)"


@query(on_hits("SELECT event_id, t_idx, round(e, 5) AS energy FROM o WHERE kept = 0 AND e >= 5", LOST))
def lost_objects_cut(t: Tables) -> DataFrame:
    """True objects of some energy that a selection leaves no row of."""
    return lost(t).where("kept = 0 and e >= 5").select("event_id", "t_idx", r("e", 5).alias("energy"))


def lost(t: Tables) -> DataFrame:
    return t.hits().where("t_idx >= 0").groupBy("event_id", "t_idx").agg(F.sum("energy").alias("e"), F.count("*").alias("n"), F.count_if(c.beta > 0.8).alias("kept"))


@query(on_hits("""SELECT round(avg(CASE WHEN kept = 0 THEN 1.0 ELSE 0.0 END), 6) AS lost_fraction, round(avg(n), 6) AS hits_mean, max(n) AS hits_max, round(sum(kept)*1.0/sum(CASE WHEN kept > 0 THEN 1 ELSE 0 END), 6) AS kept_mean, max(kept) AS kept_max, round(avg(CASE WHEN kept = 0 THEN e END), 5) AS lost_mean,
  round(max(CASE WHEN kept = 0 THEN e END), 5) AS lost_max, round(sum(CASE WHEN kept = 0 THEN e END), 3) AS lost_sum, round(sum(kept)*1.0/sum(n), 6) AS reduction FROM o""", LOST))
def lost_object_set(t: Tables) -> DataFrame:
    """What a selection loses: share of objects, rows an object before and after, lost energy, reduction without noise."""
    gone = F.col("kept") == 0
    e = F.when(gone, F.col("e"))
    return lost(t).agg(
        r(F.avg(F.when(gone, 1.0).otherwise(0.0))).alias("lost_fraction"), r(F.avg("n")).alias("hits_mean"), F.max("n").alias("hits_max"), r(F.sum("kept") / F.count_if(~gone)).alias("kept_mean"), F.max("kept").alias("kept_max"),
        r(F.avg(e), 5).alias("lost_mean"), r(F.max(e), 5).alias("lost_max"), r(F.sum(e), 3).alias("lost_sum"), r(F.sum("kept") / F.sum("n")).alias("reduction"),
    )


@query(on_hits("SELECT round(sum(CASE WHEN h.t_idx = a.t_idx THEN h.energy ELSE 0 END)/sum(h.energy), 6) AS purity, round(count(DISTINCT h.event_id*100000 + a.hit_id)*1.0/count(*), 6) AS reduction FROM hits h JOIN down d ON d.event_id = h.event_id AND d.hit_id = h.hit_id AND d.rn = 1 JOIN hits a ON a.event_id = d.event_id AND a.hit_id = d.up_id", UP, DOWN))
def condensation_purity(t: Tables) -> DataFrame:
    """Share of energy whose up node has the same truth, and how many up nodes the rows come down to."""
    nearest = F.col("near")[0]
    rows = transition(t.hits(), carry=("t_idx", "energy")).select("event_id", nearest["nbr_id"].alias("up_id"), nearest["n_t_idx"].alias("up_truth"), "t_idx", "energy")
    same = F.sum(F.when(F.col("t_idx") == F.col("up_truth"), c.energy).otherwise(0.0))
    return rows.agg(r(same / F.sum("energy")).alias("purity"), r(F.count_distinct("event_id", "up_id") / F.count("*")).alias("reduction"))


@query(on_hits("SELECT event_id, t_idx, round(sum(q*energy)/(sum(q)+1e-6), 5) AS payload, round(1-max(beta), 6) AS beta_penalty FROM q WHERE t_idx >= 0 GROUP BY 1, 2", Q))
def payload_average(t: Tables) -> DataFrame:
    """Charge-weighted payload of objects beside their beta penalty."""
    hits, _ = charged(t)
    return hits.where("t_idx >= 0").groupBy("event_id", "t_idx").agg(r(F.sum(F.col("q") * c.energy) / (F.sum("q") + 1e-6), 5).alias("payload"), r(1 - F.max("beta")).alias("beta_penalty"))


@query(on_hits("SELECT d.event_id, up_id, round(sum(weight*energy) + max(u.e), 5) AS pushed, arg_max(h.t_idx, weight*1000000 - h.hit_id/1000.0) AS truth FROM down d JOIN hits h USING (event_id, hit_id) JOIN (SELECT event_id, hit_id AS up_id, energy AS e FROM hits) u USING (event_id, up_id) GROUP BY 1, 2", UP, DOWN))
def push_up_truth(t: Tables) -> DataFrame:
    """Energy of up nodes, their own included, and the truth of the row that weighs most below each."""
    d = down_edges(transition(t.hits(), carry=("energy", "t_idx")), "energy", "t_idx")
    return d.groupBy("event_id", "up_id").agg(r(F.sum(F.col("weight") * c.energy) + F.max("n_energy"), 5).alias("pushed"), F.max_by("t_idx", F.col("weight") * 1000000 - F.col("hit_id") / 1000.0).alias("truth"))


@query(on_hits("SELECT event_id, hit_id, round(coalesce(w/nullif(m, 0), 0), 6) AS relative, round(greatest(w/nullif(m, 0)-0.3, 0.0)/nullif(sum(greatest(w/nullif(m, 0)-0.3, 0.0)) OVER (PARTITION BY event_id, t_idx), 0), 6) AS cut FROM (SELECT *, max(w) OVER (PARTITION BY event_id, t_idx) AS m FROM (SELECT *, pow(atanh(beta/1.01), 2) AS w FROM hits WHERE t_idx >= 0))"))
def payload_weights_cut(t: Tables) -> DataFrame:
    """Weights by their object's greatest, less a threshold, normalised again; objects without any weight have 0 and no cut."""
    w = Window.partitionBy("event_id", "t_idx")
    a = F.atanh(c.beta / 1.01)
    rows = t.hits().where("t_idx >= 0").withColumn("w", a * a).withColumn("rel", F.try_divide("w", F.max("w").over(w)))
    rows = rows.withColumn("cut", F.greatest(F.col("rel") - 0.3, F.lit(0.0)))
    return rows.select(*KEY, r(F.coalesce("rel", F.lit(0.0))).alias("relative"), r(F.try_divide("cut", F.sum("cut").over(w))).alias("cut"))


@query(on_hits("SELECT event_id, hit_id, round(sqrt(x*x+y*y+z*z), 6) AS radius, round(CASE WHEN x = 0 AND y = 0 THEN 0 ELSE atan(y/(x+1e-6)) END, 6) AS phi, round(CASE WHEN sqrt(x*x+y*y+z*z) = 0 THEN 0 ELSE acos(z/sqrt(x*x+y*y+z*z)) END, 6) AS theta FROM hits"))
def spherical_nan_to_zero(t: Tables) -> DataFrame:
    """Spherical coordinates in which what is not a number becomes 0."""
    radius = F.sqrt(c.x * c.x + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return t.hits().select(*KEY, r(radius).alias("radius"), r(F.nanvl(F.atan(F.col("y") / (c.x + 1e-6)), F.lit(0.0))).alias("phi"), r(F.coalesce(F.acos(F.try_divide(F.col("z"), radius)), F.lit(0.0))).alias("theta"))


@query(on_hits("SELECT event_id, hit_id, round(exp(-x*x/200), 6) AS bell, round(exp(tax)-1, 6) AS expm1, round(greatest(x-25, 0)+1e-6, 6) AS positive, 1.0::DOUBLE AS ones, 0.0::DOUBLE AS zeros FROM hits"))
def small_functions(t: Tables) -> DataFrame:
    """Bell, exp - 1, positive part, constants; numbers that are not finite stop the query."""
    checked = F.when(F.isnan("x"), F.raise_error(F.lit("x is not a number")).cast("double")).otherwise(c.x)
    return t.hits().withColumn("x", checked).select(*KEY, r(F.exp(-c.x * c.x / 200)).alias("bell"), r(F.expm1("tax")).alias("expm1"), r(F.greatest(c.x - 25, F.lit(0.0)) + 1e-6).alias("positive"), F.lit(1.0).alias("ones"), F.lit(0.0).alias("zeros"))


@query(on_hits("""SELECT event_id, hit_id, cx*ny + cy AS cell, row_number() OVER (PARTITION BY event_id ORDER BY cx*ny + cy, hit_id) - 1 AS place, count(*) OVER (PARTITION BY event_id, cx*ny + cy) AS in_cell, nx*ny AS cells FROM (SELECT *, CAST(floor((x-lx)/(greatest(hx-lx, 1e-9)*1.00001/nx)) AS BIGINT) AS cx, CAST(floor((y-ly)/(greatest(hy-ly, 1e-9)*1.00001/ny)) AS BIGINT) AS cy
  FROM (SELECT *, greatest(CAST(floor((hx-lx)/10) AS BIGINT), 2) AS nx, greatest(CAST(floor((hy-ly)/10) AS BIGINT), 2) AS ny FROM (SELECT event_id, hit_id, x, y, min(x) OVER w AS lx, max(x) OVER w AS hx, min(y) OVER w AS ly, max(y) OVER w AS hy FROM hits WINDOW w AS (PARTITION BY event_id))))"""))
def latent_grid_order(t: Tables) -> DataFrame:
    """Cells of each event's own grid, the order that brings their rows together, and how many rows and cells there are."""
    w = Window.partitionBy("event_id")
    rows = t.hits().select(*KEY, "x", "y", *(f(a).over(w).alias(n + a) for a in "xy" for n, f in (("l", F.min), ("h", F.max))))
    rows = rows.withColumns({f"n{a}": F.greatest(F.floor((F.col(f"h{a}") - F.col(f"l{a}")) / 10), F.lit(2).cast("long")) for a in "xy"})
    rows = rows.withColumns({f"c{a}": F.floor((F.col(a) - F.col(f"l{a}")) / (F.greatest(F.col(f"h{a}") - F.col(f"l{a}"), F.lit(1e-9)) * 1.00001 / F.col(f"n{a}"))) for a in "xy"})
    rows = rows.withColumn("cell", F.col("cx") * F.col("ny") + F.col("cy"))
    place = (F.row_number().over(w.orderBy("cell", "hit_id")) - 1).cast("long")
    return rows.select(*KEY, "cell", place.alias("place"), F.count("*").over(Window.partitionBy("event_id", "cell")).alias("in_cell"), (F.col("nx") * F.col("ny")).alias("cells"))


@query(on_hits(f"SELECT event_id, t_idx, page, array_to_string(list(hit_id ORDER BY hit_id), ',') AS others, count(*) AS n FROM (SELECT o.event_id, o.t_idx, h.hit_id, (row_number() OVER (PARTITION BY o.event_id, o.t_idx ORDER BY h.hit_id) - 1) // {PAGE} AS page FROM (SELECT DISTINCT event_id, t_idx FROM hits WHERE t_idx >= 0) o JOIN hits h ON h.event_id = o.event_id AND h.t_idx <> o.t_idx AND h.t_idx >= 0) GROUP BY 1, 2, 3"))
def object_complement_members(t: Tables) -> DataFrame:
    """The rows of an event's other objects by object, in pages of fixed length: what is asked for is rows times objects."""
    rows = t.hits().where("t_idx >= 0")
    objects = rows.select("event_id", F.col("t_idx").alias("own")).distinct()
    others = rows.join(objects, "event_id").where("t_idx <> own").select("event_id", F.col("own").alias("t_idx"), "hit_id")
    return sel.paged(others, ["event_id", "t_idx"], "hit_id", PAGE, "m").select("event_id", "t_idx", "page", F.array_join("m", ",").alias("others"), "n")


@query(on_hits("SELECT d.event_id, d.hit_id, round(sum(weight*u.energy)*3, 5) AS total, round(sum(weight*u.energy) + h.energy, 5) AS mixed FROM down d JOIN hits u ON u.event_id = d.event_id AND u.hit_id = d.up_id JOIN hits h ON h.event_id = d.event_id AND h.hit_id = d.hit_id GROUP BY d.event_id, d.hit_id, h.energy", UP, DOWN))
def pull_down_mix(t: Tables) -> DataFrame:
    """Sums of up nodes on the rows below, and the rows' own values with them."""
    s = ed.softmax_sum(F.col("near"), lambda n: n["n_energy"], SCALE)
    return transition(t.hits(), carry=("energy",)).select(*KEY, r(s * 3, 5).alias("total"), r(s + c.energy, 5).alias("mixed"))
