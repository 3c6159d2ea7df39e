"""Queries of binned metrics, reductions, potentials and the metrics store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.operators import knn as kn
from hitloom.plans.objects import IOU, predicted
from hitloom.functions.columns import c
from hitloom.plans.registry import K, on_edges, on_hits, query, r
from hitloom.operators import edges as ed
from hitloom.operators import quantiles as qu
from hitloom.session import shared_dir
from hitloom.sources.tables import Tables

KEY = ["event_id", "hit_id"]


def bin_of(x: Column, edges: Sequence[float], closed: bool = True) -> Column:
    """Number of the half-open bin of x; the last one is closed on demand; null outside."""
    out = F.when(F.lit(False), F.lit(0))
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        last = closed and i == len(edges) - 2
        out = out.when((x >= lo) & ((x <= hi) if last else (x < hi)), i)
    return out


def all_bins(df: DataFrame, edges: Sequence[float], binned: DataFrame) -> DataFrame:
    """Every bin, empty ones with nulls."""
    grid = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lo double, hi double")
    return grid.join(F.broadcast(binned), "bin", "left")


def cases(x: str, edges: Sequence[float], closed: bool = True) -> str:
    parts = [f"WHEN {x} >= {lo} AND {x} <{'=' if closed and i == len(edges) - 2 else ''} {hi} THEN {i}" for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    return "CASE " + " ".join(parts) + " END"


def grid_sql(edges: Sequence[float]) -> str:
    rows = ", ".join(f"({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"(SELECT * FROM (VALUES {rows}) AS g(bin, lo, hi))"


EDGES = [0, 5, 10, 20, 40, 60, 80, 100, 200]


@query(on_hits(f"SELECT g.bin, lo, hi, coalesce(n, 0) AS n FROM {grid_sql(EDGES)} g LEFT JOIN (SELECT {cases('energy', EDGES)} AS bin, count(*) AS n FROM hits GROUP BY 1) h ON h.bin = g.bin"))
def histogram(t: Tables) -> DataFrame:
    n = t.hits().groupBy(bin_of(c.energy, EDGES).alias("bin")).agg(F.count("*").alias("n"))
    return all_bins(n, EDGES, n).withColumn("n", F.coalesce("n", F.lit(0)))


@query(on_hits(f"SELECT g.bin, lo, hi, round(v, 6) AS mean, round(frac, 6) AS frac FROM {grid_sql(EDGES)} g LEFT JOIN (SELECT bin, v, n/sum(n) OVER () AS frac FROM (SELECT {cases('energy', EDGES, False)} AS bin, sum(beta*x)/nullif(sum(beta), 0) AS v, count(*) AS n FROM hits GROUP BY 1)) h ON h.bin = g.bin"))
def binned_mean(t: Tables) -> DataFrame:
    """Weighted mean in half-open bins, and the share of rows."""
    n = t.hits().groupBy(bin_of(c.energy, EDGES, False).alias("bin")).agg(F.try_divide(F.sum(c.beta * c.x), F.sum("beta")).alias("v"), F.count("*").alias("n"))
    n = n.withColumn("frac", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a bin
    return all_bins(n, EDGES, n).select("bin", "lo", "hi", r("v").alias("mean"), r("frac").alias("frac"))


def rate_sql(cond: str, where: str = "TRUE") -> str:
    return on_hits(f"SELECT g.bin, lo, hi, round(m, 6) AS rate, round(sqrt(m*(1-m)/n), 6) AS error FROM {grid_sql(EDGES)} g LEFT JOIN (SELECT {cases('energy', EDGES, False)} AS bin, avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END) AS m, count(*) AS n FROM hits WHERE {where} GROUP BY 1) h ON h.bin = g.bin")


def binned_rate(df: DataFrame, x: Column, hit: Column) -> DataFrame:
    """Share of rows that hit, with its binomial error."""
    n = df.groupBy(bin_of(x, EDGES, False).alias("bin")).agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("m"), F.count("*").alias("n"))
    return all_bins(df, EDGES, n).select("bin", "lo", "hi", r("m").alias("rate"), r(F.sqrt(F.col("m") * (1 - F.col("m")) / F.col("n"))).alias("error"))


@query(rate_sql("beta > 0.5", "t_idx >= 0"))
def efficiency_binned(t: Tables) -> DataFrame:
    return binned_rate(t.hits().where("t_idx >= 0"), c.energy, c.beta > 0.5)


@query(rate_sql("t_idx < 0", "beta > 0.5"))
def fake_rate_binned(t: Tables) -> DataFrame:
    return binned_rate(t.hits().where("beta > 0.5"), c.energy, F.col("t_idx") < 0)


@query(on_hits(f"SELECT bin, round(avg(v), 6) AS response, round(avg(v)/sqrt(count(*)), 6) AS error, round(stddev_pop(v)/avg(v), 6) AS resolution, count(*) AS n FROM (SELECT {cases('energy', EDGES, False)} AS bin, x/energy AS v FROM hits WHERE energy > 0) WHERE bin IS NOT NULL GROUP BY 1"))
def response_resolution(t: Tables) -> DataFrame:
    rows = t.hits().where("energy > 0").select(bin_of(c.energy, EDGES, False).alias("bin"), (c.x / c.energy).alias("v")).where("bin is not null")
    return rows.groupBy("bin").agg(r(F.avg("v")).alias("response"), r(F.avg("v") / F.sqrt(F.count("*"))).alias("error"), r(F.stddev_pop("v") / F.avg("v")).alias("resolution"), F.count("*").alias("n"))


@query(on_hits(f"SELECT bin, round(avg(energy), 6) AS x_mean, round(avg(beta), 6) AS mean, round(sqrt(avg(beta*beta)-avg(beta)*avg(beta)), 6) AS rms, round(quantile_cont(beta, 0.25), 6) AS q25, round(quantile_cont(beta, 0.75), 6) AS q75 FROM (SELECT *, {cases('energy', EDGES, False)} AS bin FROM hits) WHERE bin IS NOT NULL GROUP BY 1"))
def profile_quantiles(t: Tables) -> DataFrame:
    rows = t.hits().withColumn("bin", bin_of(c.energy, EDGES, False)).where("bin is not null").select("bin", "energy", "beta")
    q = qu.wide(qu.quantiles(rows, "beta", [0.25, 0.75], ["bin"]), [0.25, 0.75], ["q25", "q75"], ["bin"])
    n = rows.groupBy("bin").agg(r(F.avg("energy")).alias("x_mean"), r(F.avg("beta")).alias("mean"), r(F.sqrt(F.avg(c.beta * c.beta) - F.avg("beta") * F.avg("beta"))).alias("rms"))
    return n.join(q, "bin").select("bin", "x_mean", "mean", "rms", r("q25").alias("q25"), r("q75").alias("q75"))


@query(on_hits(f"SELECT bin, round(sum(beta*energy)/sum(energy), 6) AS found, round(2*avg(beta)*avg(tax*10)/nullif(avg(beta)+avg(tax*10), 0), 6) AS f1 FROM (SELECT *, {cases('energy', EDGES, False)} AS bin FROM hits) WHERE bin IS NOT NULL GROUP BY 1"))
def energy_found(t: Tables) -> DataFrame:
    rows = t.hits().withColumn("bin", bin_of(c.energy, EDGES, False)).where("bin is not null")
    a, b = F.avg("beta"), F.avg(F.col("tax") * 10)
    return rows.groupBy("bin").agg(r(F.sum(c.beta * c.energy) / F.sum("energy")).alias("found"), r(F.try_divide(2 * a * b, a + b)).alias("f1"))


@query(on_hits("SELECT t, p, coalesce(n, 0) AS n FROM (SELECT * FROM (VALUES ('A'), ('N'), ('R')) a(t), (VALUES ('A'), ('N'), ('R')) b(p)) LEFT JOIN (SELECT cls AS t, CASE WHEN beta < 0.3 THEN 'A' WHEN beta < 0.6 THEN 'N' ELSE 'R' END AS p, count(*) AS n FROM hits GROUP BY 1, 2) USING (t, p)"))
def confusion_matrix(t: Tables) -> DataFrame:
    n = t.hits().groupBy(F.col("cls").alias("t"), F.when(c.beta < 0.3, "A").when(c.beta < 0.6, "N").otherwise("R").alias("p")).agg(F.count("*").alias("n"))
    names = ["A", "N", "R"]
    grid = n.sparkSession.createDataFrame([(a, b) for a in names for b in names], "t string, p string")
    return grid.join(F.broadcast(n), ["t", "p"], "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))


@query(on_hits("SELECT a.event_id, a.t_idx, round(a.e/sum(b.e), 6) AS local_fraction, round(sum(CASE WHEN a.t_idx <> b.t_idx THEN b.e ELSE 0 END), 5) AS other FROM objs a JOIN objs b ON a.event_id = b.event_id AND (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy) <= 25 GROUP BY 1, 2, a.e", "objs AS (SELECT event_id, t_idx, sum(energy) AS e, avg(x) AS cx, avg(y) AS cy FROM hits WHERE t_idx >= 0 GROUP BY 1, 2)"))
def local_energy_fraction(t: Tables) -> DataFrame:
    """An object's share of the energy of all objects near it, and what the others hold."""
    o = t.hits().where("t_idx >= 0").groupBy("event_id", "t_idx").agg(F.sum("energy").alias("e"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    b = o.select("event_id", *(F.col(c).alias(f"b_{c}") for c in ("t_idx", "e", "cx", "cy")))
    dx, dy = F.col("cx") - F.col("b_cx"), F.col("cy") - F.col("b_cy")
    near = o.join(b, "event_id").where(dx * dx + dy * dy <= 25)
    other = F.sum(F.when(F.col("t_idx") != F.col("b_t_idx"), F.col("b_e")).otherwise(0.0))
    return near.groupBy("event_id", "t_idx", "e").agg(F.sum("b_e").alias("s"), other.alias("other")).select("event_id", "t_idx", r(F.col("e") / F.col("s")).alias("local_fraction"), r("other", 5).alias("other"))


@query(on_hits("SELECT a.event_id, a.t_idx FROM (SELECT DISTINCT event_id, t_idx FROM hits WHERE t_idx >= 0) a WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.event_id = a.event_id AND h.t_idx = a.t_idx AND h.beta > 0.8)"))
def lost_objects(t: Tables) -> DataFrame:
    hits = t.hits().where("t_idx >= 0")
    return hits.select("event_id", "t_idx").distinct().join(hits.where("beta > 0.8").select("event_id", "t_idx"), ["event_id", "t_idx"], "left_anti")


@query(on_hits("SELECT round(count(CASE WHEN beta > 0.8 THEN 1 END)*1.0/count(*), 6) AS reduction, round(sum(CASE WHEN beta > 0.8 AND t_idx >= 0 THEN energy END)/sum(CASE WHEN beta > 0.8 THEN energy END), 6) AS purity, round(sum(CASE WHEN beta > 0.8 AND t_idx >= 0 THEN energy END)/sum(CASE WHEN t_idx >= 0 THEN energy END), 6) AS efficiency, round(avg(CASE WHEN (beta > 0.8) = (t_idx >= 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM hits"))
def reduction_metrics(t: Tables) -> DataFrame:
    kept, true = c.beta > 0.8, F.col("t_idx") >= 0
    s = lambda cond: F.sum(F.when(cond, c.energy))
    return t.hits().agg(
        r(F.count_if(kept) / F.count("*")).alias("reduction"), r(s(kept & true) / s(kept)).alias("purity"), r(s(kept & true) / s(true)).alias("efficiency"),
        r(F.avg(F.when(kept == true, 1.0).otherwise(0.0))).alias("accuracy"),
    )


@query(on_edges("SELECT slot, round(avg(dsq), 5) AS mean, round(max(dsq), 5) AS max, count(*) AS n FROM edges GROUP BY 1"))
def neighbour_distances(t: Tables) -> DataFrame:
    return kn.knn(t.hits(), K).groupBy(F.col("slot").cast("long").alias("slot")).agg(r(F.avg("dsq"), 5).alias("mean"), r(F.max("dsq"), 5).alias("max"), F.count("*").alias("n"))


@query(on_hits("SELECT event_id, round(sum(rel*g), 6) AS lovasz FROM (SELECT *, jac - coalesce(lag(jac) OVER (PARTITION BY event_id ORDER BY rk), 0) AS g FROM (SELECT *, 1-(p-cum)/(p+rk-cum) AS jac FROM (SELECT event_id, greatest(err, 0.0) AS rel, row_number() OVER w AS rk, sum(lab) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(lab) OVER (PARTITION BY event_id) AS p FROM (SELECT event_id, hit_id, CASE WHEN t_idx >= 2 THEN 1.0 ELSE 0.0 END AS lab, 1-(2*beta-1)*(CASE WHEN t_idx >= 2 THEN 1 ELSE -1 END) AS err FROM hits) WINDOW w AS (PARTITION BY event_id ORDER BY err DESC, hit_id)))) GROUP BY 1"))
def lovasz_hinge(t: Tables) -> DataFrame:
    lab = F.when(F.col("t_idx") >= 2, 1.0).otherwise(0.0)
    rows = t.hits().select(*KEY, lab.alias("lab"), (1 - (2 * c.beta - 1) * (2 * lab - 1)).alias("err"))
    ev = Window.partitionBy("event_id")
    w = ev.orderBy(F.desc("err"), "hit_id")
    rows = rows.withColumn("rk", F.row_number().over(w)).withColumn("cum", F.sum("lab").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("p", F.sum("lab").over(ev))
    rows = rows.withColumn("jac", 1 - (F.col("p") - F.col("cum")) / (F.col("p") + F.col("rk") - F.col("cum")))
    g = F.col("jac") - F.coalesce(F.lag("jac").over(ev.orderBy("rk")), F.lit(0.0))
    return rows.withColumn("g", g).groupBy("event_id").agg(r(F.sum(F.greatest("err", F.lit(0.0)) * F.col("g"))).alias("lovasz"))


Q = "q AS (SELECT *, (pow(atanh(beta/1.01), 2)+0.1) AS q FROM hits)"
ALPHA = "al AS (SELECT event_id, t_idx, x AS ax, y AS ay, q AS qa FROM (SELECT *, row_number() OVER (PARTITION BY event_id, t_idx ORDER BY q DESC, hit_id) AS rn FROM q WHERE t_idx >= 0) WHERE rn = 1)"


def charged(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Hits with their charge, and each object's strongest row."""
    a = F.atanh(c.beta / 1.01)
    hits = t.hits().withColumn("q", a * a + 0.1)
    w = Window.partitionBy("event_id", "t_idx").orderBy(F.desc("q"), "hit_id")
    alpha = hits.where("t_idx >= 0").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return hits, alpha.select("event_id", "t_idx", c.x.alias("ax"), F.col("y").alias("ay"), F.col("q").alias("qa"))


def d2() -> Column:
    return (c.x - F.col("ax")) * (c.x - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay"))
D2_SQL = "((x-ax)*(x-ax)+(y-ay)*(y-ay))"


@query(on_hits(f"SELECT q.event_id, q.t_idx, round(sum(qa*ln(exp(1)*{D2_SQL}/200+1)*q)/(count(*)+1e-3), 5) AS att FROM q JOIN al USING (event_id, t_idx) GROUP BY 1, 2", Q, ALPHA))
def oc_potential_att(t: Tables) -> DataFrame:
    hits, alpha = charged(t)
    v = F.sum(F.col("qa") * F.log(F.exp(F.lit(1.0)) * d2() / 200 + 1) * F.col("q")) / (F.count("*") + 1e-3)
    return hits.join(alpha, ["event_id", "t_idx"]).groupBy("event_id", "t_idx").agg(r(v, 5).alias("att"))


@query(on_hits(f"SELECT q.event_id, al.t_idx, round(sum(qa*exp(-{D2_SQL}/200)*q)/(count(*)+1e-3), 5) AS rep FROM q JOIN al ON al.event_id = q.event_id AND al.t_idx <> q.t_idx GROUP BY 1, 2", Q, ALPHA))
def oc_potential_rep(t: Tables) -> DataFrame:
    """Repulsion of all rows that are not an object's own; the join stays inside events."""
    hits, alpha = charged(t)
    both = hits.withColumnRenamed("t_idx", "own").join(alpha, "event_id").where("own <> t_idx")
    v = F.sum(F.col("qa") * F.exp(-d2() / 200) * F.col("q")) / (F.count("*") + 1e-3)
    return both.groupBy("event_id", "t_idx").agg(r(v, 5).alias("rep"))


@query(on_hits("SELECT event_id, round(avg(1-m), 6) AS beta_penalty, round(max(nb), 6) AS noise FROM (SELECT event_id, t_idx, max(beta) AS m, max(nb) AS nb FROM (SELECT *, avg(CASE WHEN t_idx < 0 THEN beta END) OVER (PARTITION BY event_id) AS nb FROM hits) WHERE t_idx >= 0 GROUP BY 1, 2) GROUP BY 1"))
def oc_beta_penalty(t: Tables) -> DataFrame:
    hits = t.hits().withColumn("nb", F.avg(F.when(F.col("t_idx") < 0, c.beta)).over(Window.partitionBy("event_id")))
    o = hits.where("t_idx >= 0").groupBy("event_id", "t_idx").agg(F.max("beta").alias("m"), F.max("nb").alias("nb"))
    return o.groupBy("event_id").agg(r(F.avg(1 - F.col("m"))).alias("beta_penalty"), r(F.max("nb")).alias("noise"))


@query(on_edges("SELECT e.event_id, round(avg(CASE WHEN a.t_idx = b.t_idx THEN -ln(exp(-dsq/100)*0.98+0.01) ELSE -ln(1-exp(-dsq/100)*0.98-0.01) END), 5) AS loss FROM edges e JOIN hits a USING (event_id, hit_id) JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id WHERE slot > 0 GROUP BY 1"))
def edge_cross_entropy(t: Tables) -> DataFrame:
    e = ed.with_neighbour(ed.with_own(kn.knn(t.hits(), K, carry=("t_idx",)).where("slot > 0"), t.hits(), "t_idx"), t.hits(), "t_idx")
    p = F.exp(-F.col("dsq") / 100) * 0.98 + 0.01
    return e.groupBy("event_id").agg(r(F.avg(F.when(F.col("t_idx") == F.col("n_t_idx"), -F.log(p)).otherwise(-F.log(1 - p))), 5).alias("loss"))


@query(on_hits("SELECT CAST(floor(v) AS BIGINT) AS bin, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT round(iou*10, 9) AS v FROM ious) WHERE v >= 1 GROUP BY 1", IOU))
def overlap_histogram(t: Tables) -> DataFrame:
    """Overlaps of 0.1 and more by tenths; they are rounded first, as the order of a sum would choose the bin of those on a border."""
    from hitloom.operators.matching import overlap

    v = r(F.col("iou") * 10, 9).alias("v")
    return overlap(predicted(t), "t_idx", "pred", "energy").select(v).where("v >= 1").groupBy(F.floor("v").alias("bin")).agg(F.count("*").alias("n"), r(F.avg("v")).alias("mean"))


@query("SELECT event_type, count(*) AS n, round(sum(v), 5) AS total, round(max(v), 5) AS top FROM (SELECT event_type, user_id, CASE WHEN isnan(value) OR isinf(value) THEN 0 ELSE value END AS v FROM events) WHERE v > 5 AND event_type IN ('click', 'view') GROUP BY 1")
def store_read(t: Tables) -> DataFrame:
    """A metrics store: rows appended by experiment, then read for some experiments under a condition."""
    import uuid

    from hitloom.sources.store import MetricsStore

    store = MetricsStore(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")
    store.insert("values", t.table("events").select(F.col("event_type").alias("experiment_name"), "user_id", "value"))
    got = store.get_data("values", experiments=["click", "view"], condition="value > 5")
    return got.groupBy(F.col("experiment_name").alias("event_type")).agg(F.count("*").alias("n"), r(F.sum("value"), 5).alias("total"), r(F.max("value"), 5).alias("top"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events WHERE event_id > 100 GROUP BY 1")
def incremental_fetch(t: Tables) -> DataFrame:
    """Only rows past the high-water mark, by a filter that the scan takes."""
    return t.table("events").where("event_id > 100").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
