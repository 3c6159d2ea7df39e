"""Queries of profiles, shapes of events, edge targets, losses and further sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitloom.functions.columns import c
from hitloom.operators import condense as co
from hitloom.operators import edges as ed
from hitloom.operators import knn as kn
from hitloom.operators import scans as sc
from hitloom.operators import shapes as sh
from hitloom.plans.metrics import all_bins, bin_of, cases, grid_sql
from hitloom.plans.objects import ALPHAS, GREEDY
from hitloom.session import removed, shared_dir
from hitloom.plans.registry import K, on_edges, on_hits, query, r
from hitloom.sources import blobs, csv
from hitloom.sources.tables import Tables

KEY = ["event_id", "hit_id"]


@query("SELECT l_orderkey, count(*) AS cells, round(sum(l_extendedprice), 4) AS energy FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)) GROUP BY 1")
def semi_join_chain(t: Tables) -> DataFrame:
    """Cells of the hits of selected particles, summed by hit: two semi-joins, no rows repeated."""
    chosen = t.table("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    orders = t.table("orders").join(chosen, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    cells = t.table("lineitem").select("l_orderkey", "l_extendedprice").join(orders, "l_orderkey", "left_semi")
    return cells.groupBy("l_orderkey").agg(F.count("*").alias("cells"), r(F.sum("l_extendedprice"), 4).alias("energy"))


@query("SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 4) AS total FROM supplier GROUP BY 1")
def csv_scan(t: Tables) -> DataFrame:
    """A table written as CSV files with headers, then read under a schema."""
    path = f"{shared_dir(t.spark)}/csv-{uuid.uuid4().hex}"
    t.table("supplier").select("s_suppkey", "s_nationkey", "s_acctbal").write.option("header", True).csv(path)
    rows = csv.scan(t.spark, path, "s_suppkey long, s_nationkey int, s_acctbal double")
    told = rows.groupBy("s_nationkey").agg(F.count("*").alias("n"), r(F.sum("s_acctbal"), 4).alias("total"))
    # A row a nation goes through the driver, so that the files can go.
    told = t.spark.createDataFrame(told.collect(), told.schema)
    removed(t.spark, path)
    return told


def drawn(name: str, *keys: str) -> str:
    """The generator's number in (0, 1)."""
    text = " || '-' || ".join(keys)
    return f"(('0x' || substr(md5('7-{name}-' || {text}), 1, 8))::BIGINT + 0.5) / 4294967296.0"


_ROW = ("event_id", "t_idx", "k")
_PLACE = ", ".join(
    f"CASE WHEN t_idx < 0 THEN 20*{drawn(d, *_ROW)}-10 ELSE 20*{drawn('centre ' + d, 'event_id', 't_idx')}-10 + 0.5*sqrt(-2*ln({drawn(d + ' radius', *_ROW)}))*cos(2*pi()*{drawn(d + ' angle', *_ROW)}) END AS {d}" for d in "xyz"
)


@query(f"""WITH blob AS (SELECT s_suppkey AS event_id, unnest(range(-1, 2 + floor({drawn('blobs', 's_suppkey')}*5)::BIGINT)) AS t_idx FROM supplier),
  rows AS (SELECT event_id, t_idx, unnest(range(1, 1 + CASE WHEN t_idx < 0 THEN 10 ELSE 1800 + floor({drawn('rows', 'event_id', 't_idx')}*100)::BIGINT END)) AS k FROM blob),
  hits AS (SELECT event_id, t_idx, {_PLACE} FROM rows)
  SELECT event_id, t_idx::INTEGER AS t_idx, count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z FROM hits GROUP BY 1, 2""")
def blob_events(t: Tables) -> DataFrame:
    """An event of generated blobs for each supplier, one row per blob."""
    hits = blobs.events(t.table("supplier").select(F.col("s_suppkey").alias("event_id")), seed=7)
    return hits.groupBy("event_id", "t_idx").agg(F.count("*").alias("n"), r(F.avg("x"), 4).alias("x"), r(F.avg("y"), 4).alias("y"), r(F.avg("z"), 4).alias("z"))


@query(on_hits("SELECT count(*) AS events, round(avg(n), 6) AS rows_mean, max(n) AS rows_max, round(avg(truth/n), 6) AS truth_mean, count(CASE WHEN truth < 0.5*n THEN 1 END) AS poor FROM (SELECT event_id, count(*) AS n, sum(CASE WHEN t_idx >= 0 THEN 1.0 ELSE 0.0 END) AS truth FROM hits GROUP BY 1)"))
def dataset_profile(t: Tables) -> DataFrame:
    """Rows per event, shares of rows with truth, and events with too little of it."""
    e = t.hits().groupBy("event_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("t_idx") >= 0, 1.0).otherwise(0.0)).alias("truth"))
    return e.agg(
        F.count("*").alias("events"), r(F.avg("n")).alias("rows_mean"), F.max("n").alias("rows_max"), r(F.avg(F.col("truth") / F.col("n"))).alias("truth_mean"),
        F.count_if(F.col("truth") < 0.5 * F.col("n")).alias("poor"),
    )


@query(on_edges("SELECT e.event_id, e.hit_id, round(sum(CASE WHEN slot > 0 THEN b.beta ELSE 0 END)/(count(*)-1+0.1)*(1+sqrt(sum(b.energy))), 5) AS score FROM edges e JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id GROUP BY 1, 2"))
def group_score(t: Tables) -> DataFrame:
    e = ed.with_neighbour(kn.knn(t.hits(), K, carry=("beta", "energy",)), t.hits(), "beta", "energy")
    mean = F.sum(F.when(F.col("slot") > 0, F.col("n_beta")).otherwise(0.0)) / (F.count("*") - 1 + 0.1)
    return e.groupBy(*KEY).agg(r(mean * (1 + F.sqrt(F.sum("n_energy"))), 5).alias("score"))


@query(on_hits("SELECT event_id, pred, round(sum(CASE WHEN t_idx = own THEN energy ELSE 0 END)/sum(energy)+1e-3, 6) AS purity, count(*) AS n FROM (SELECT *, first_value(t_idx) OVER (PARTITION BY event_id, pred ORDER BY beta DESC, hit_id) AS own FROM (SELECT *, CAST(floor(x/17) AS BIGINT) AS pred FROM hits)) GROUP BY 1, 2"))
def object_purity(t: Tables) -> DataFrame:
    """Energy share of a predicted object's rows with the truth of its best row."""
    w = Window.partitionBy("event_id", "pred").orderBy(F.desc("beta"), "hit_id")
    rows = t.hits().withColumn("pred", F.floor(c.x / 17)).withColumn("own", F.first("t_idx").over(w))
    same = F.sum(F.when(F.col("t_idx") == F.col("own"), c.energy).otherwise(0.0))
    return rows.groupBy("event_id", "pred").agg(r(same / F.sum("energy") + 1e-3).alias("purity"), F.count("*").alias("n"))


@query(on_hits("""SELECT event_id, round(CASE WHEN m > pi() THEN m-2*pi() WHEN m <= -pi() THEN m+2*pi() ELSE m END, 5) AS phi FROM (SELECT event_id, max(top)+sum(energy*CASE WHEN p-top > pi() THEN p-top-2*pi() WHEN p-top <= -pi() THEN p-top+2*pi() ELSE p-top END)/sum(energy) AS m
  FROM (SELECT *, first_value(p) OVER (PARTITION BY event_id ORDER BY energy DESC, hit_id) AS top FROM (SELECT *, atan2(y-25, x-25) AS p FROM hits)) GROUP BY 1)"""))
def phi_centre(t: Tables) -> DataFrame:
    """Energy-weighted angle of each event, measured from its strongest row so that the wrap does no harm."""
    return sh.weighted_angle(t.hits().withColumn("phi", F.atan2(F.col("y") - 25, c.x - 25)), "phi", "energy").select("event_id", r("phi", 5).alias("phi"))


@query(on_hits("SELECT event_id, agg, round(avg(w*energy), 5) AS mean, round(max(w*energy), 5) AS top FROM (SELECT event_id, energy, 0 AS agg, exp(-(x/50)*(x/50)) AS w FROM hits UNION ALL SELECT event_id, energy, 1, exp(-(y/50)*(y/50)) FROM hits) GROUP BY 1, 2"))
def aggregators(t: Tables) -> DataFrame:
    """Mean and maximum of a feature per event under several distance weights."""
    ways = F.posexplode(F.array(c.x / 50, F.col("y") / 50)).alias("agg", "d")
    rows = t.hits().select("event_id", "energy", ways).withColumn("v", F.exp(-F.col("d") * F.col("d")) * c.energy)
    return rows.groupBy("event_id", "agg").agg(r(F.avg("v"), 5).alias("mean"), r(F.max("v"), 5).alias("top"))


def jacobi_sql(m: int, start: str, name: str = "axes") -> str:
    """Rotations of every event's matrix (start: event_id, a as a flat list) as a recursive table: event_id, a, v."""
    pairs = [(p, q) for p in range(m) for q in range(p + 1, m)]
    plan = ", ".join(f"({n}, {p}, {q})" for n, (p, q) in enumerate(pairs * sh.SWEEPS))
    one = ", ".join(str(float(i == j)) for i in range(m) for j in range(m))

    def turned(x: str, place: str, stride: int) -> str:
        return f"list_transform({x}, lambda e, i: CASE WHEN {place} = p THEN c*e - s*{x}[i+(q-p)*{stride}] WHEN {place} = q THEN s*{x}[i-(q-p)*{stride}] + c*e ELSE e END)"

    return f"""plan(n, p, q) AS (VALUES {plan}), {name} AS (WITH RECURSIVE turn(event_id, n, a, v) AS (
    SELECT event_id, 0, a, CAST([{one}] AS DOUBLE[]) FROM ({start})
    UNION ALL SELECT event_id, n + 1, {turned('b', '(i-1)//' + str(m), m)}, v FROM (
      SELECT event_id, n, p, q, c, s, {turned('a', f'(i-1)%{m}', 1)} AS b, {turned('v', f'(i-1)%{m}', 1)} AS v FROM (
        SELECT *, 1/sqrt(1+t*t) AS c, t/sqrt(1+t*t) AS s FROM (SELECT event_id, turn.n, p, q, a, v, CASE WHEN a[p*{m}+q+1] = 0 THEN 0 ELSE a[p*{m}+q+1]*(CASE WHEN a[q*{m}+q+1] < a[p*{m}+p+1] THEN -1 ELSE 1 END)
          /(abs((a[q*{m}+q+1]-a[p*{m}+p+1])/2)+sqrt(pow((a[q*{m}+q+1]-a[p*{m}+p+1])/2, 2)+a[p*{m}+q+1]*a[p*{m}+q+1])) END AS t FROM turn JOIN plan ON plan.n = turn.n))))
    SELECT event_id, a, v FROM turn WHERE n = {len(pairs) * sh.SWEEPS})"""


def moments_sql(features: tuple[str, ...], scaled: bool) -> str:
    """Covariances of an event's features (correlations, if scaled) as a flat list."""
    entry = lambda x, y: f"covar_pop({x}, {y})" + (f"/coalesce(nullif(stddev_pop({x}), 0), 1)/coalesce(nullif(stddev_pop({y}), 0), 1)" if scaled else "")
    return f"SELECT event_id, [{', '.join(entry(x, y) for x in features for y in features)}] AS a FROM hits GROUP BY 1 HAVING count(*) >= 10"


SHAPE = ("x", "y", "z")


@query(on_hits("SELECT event_id, round(ln(pow((a[1]+a[5]+a[9])/3/least(a[1], a[5], a[9])-1, 2)+1), 4) AS ratio FROM axes", jacobi_sql(3, moments_sql(SHAPE, False))))
def shape_ratio(t: Tables) -> DataFrame:
    """How stretched an event is: its mean over its least variance along principal axes."""
    return sh.axis_ratio(t.hits(), SHAPE, 10).select("event_id", r("ratio", 4).alias("ratio"))


SPECTATOR = ("x", "y", "z", "beta", "tax")


@query(on_hits(f"""SELECT event_id, hit_id, round(sqrt(sum(along*along/value)), 4) AS score FROM (SELECT z.event_id, hit_id, value, z1*v[k]+z2*v[5+k]+z3*v[10+k]+z4*v[15+k]+z5*v[20+k] AS along
  FROM (SELECT event_id, hit_id, {", ".join(f"({f}-avg({f}) OVER w)/stddev_pop({f}) OVER w AS z{i}" for i, f in enumerate(SPECTATOR, 1))} FROM hits WINDOW w AS (PARTITION BY event_id)) z
  JOIN (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY value DESC) AS place FROM (SELECT event_id, v, unnest([1, 2, 3, 4, 5]) AS k, unnest([a[1], a[7], a[13], a[19], a[25]]) AS value FROM axes)) x ON x.event_id = z.event_id AND place <= 2) GROUP BY 1, 2""",
  jacobi_sql(5, moments_sql(SPECTATOR, True))))
def spectator_scores(t: Tables) -> DataFrame:
    """Mahalanobis distances of five standardised features, projected on their two strongest axes."""
    return sh.outlier_scores(t.hits(), SPECTATOR, 2, 10).select(*KEY, r("score", 4).alias("score"))


@query(on_hits("SELECT event_id, round(coalesce(sum(CASE WHEN beta > 0.5 THEN x END)/count(CASE WHEN beta > 0.5 AND x <> 0 THEN 1 END), 0), 5) AS pooled FROM hits GROUP BY 1"))
def masked_pool(t: Tables) -> DataFrame:
    """Mean of the rows that a mask leaves non-zero; 0 where it leaves none."""
    v = F.when(c.beta > 0.5, c.x)
    return t.hits().groupBy("event_id").agg(r(F.coalesce(F.try_divide(F.sum(v), F.count_if(v != 0)), F.lit(0.0)), 5).alias("pooled"))


@query(on_hits("SELECT event_id, hit_id, t_idx FROM (SELECT *, row_number() OVER (PARTITION BY event_id, t_idx ORDER BY hit_id DESC) AS rn FROM hits) WHERE t_idx >= 0 OR rn = 1"))
def collapse_noise(t: Tables) -> DataFrame:
    """Objects whole, and one row that stands for an event's noise."""
    w = Window.partitionBy("event_id", "t_idx").orderBy(F.desc("hit_id"))
    return t.hits().withColumn("rn", F.row_number().over(w)).where("t_idx >= 0 or rn = 1").select(*KEY, "t_idx")


SLICES, RATIOS = [0, 10, 30, 60, 200], [0, 0.25, 0.5, 1, 2, 4, 100]


@query(on_hits(f"SELECT {cases('energy', SLICES, False)} AS slice, {cases('x/energy', RATIOS)} AS bin, count(*) AS n FROM hits WHERE energy > 0 GROUP BY 1, 2"))
def response_slices(t: Tables) -> DataFrame:
    return t.hits().where("energy > 0").groupBy(bin_of(c.energy, SLICES, False).alias("slice"), bin_of(c.x / c.energy, RATIOS).alias("bin")).agg(F.count("*").alias("n"))


WIDE = ", ".join(f"round(avg(CASE WHEN s = {i} THEN x END), 5) AS mean_{i}, count(CASE WHEN s = {i} THEN 1 END) AS n_{i}" for i in range(4))


@query(on_hits(f"SELECT cls, {WIDE} FROM (SELECT *, {cases('energy', SLICES, False)} AS s FROM hits) GROUP BY 1"))
def binned_wide(t: Tables) -> DataFrame:
    """Binned values as one wide row per tag, the form in which a metrics store keeps them."""
    rows = t.hits().withColumn("s", bin_of(c.energy, SLICES, False))
    of = [F.when(F.col("s") == i, c.x) for i in range(4)]
    return rows.groupBy("cls").agg(*(r(F.avg(v), 5).alias(f"mean_{i}") for i, v in enumerate(of)), *(F.count(v).alias(f"n_{i}") for i, v in enumerate(of)))


@query(on_hits(f"SELECT cls, CAST(s AS INTEGER) AS bin, round(avg(x), 5) AS mean, count(*) AS n FROM (SELECT *, {cases('energy', SLICES, False)} AS s FROM hits) WHERE s IS NOT NULL GROUP BY 1, 2"))
def binned_reload(t: Tables) -> DataFrame:
    """The wide rows as long ones again; bins without rows go."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("bin"), F.col(f"mean_{i}").alias("mean"), F.col(f"n_{i}").alias("n")) for i in range(4))))
    return binned_wide(t).select("cls", pairs.alias("p")).where("p.n > 0").select("cls", "p.*")


LOGS = [1, 2, 5, 10, 20, 50, 100, 200]


@query(on_hits(f"SELECT g.bin, lo, hi, coalesce(n, 0) AS n, coalesce(kept, 0) AS kept, round(kept*1.0/n, 6) AS efficiency FROM {grid_sql(LOGS)} g LEFT JOIN (SELECT {cases('e', LOGS)} AS bin, count(*) AS n, count(CASE WHEN k THEN 1 END) AS kept FROM (SELECT event_id, energy AS e, bool_or(beta > 0.5) AS k FROM hits GROUP BY 1, 2) GROUP BY 1) h ON h.bin = g.bin"))
def survival_efficiency(t: Tables) -> DataFrame:
    """Distinct energies of each event before and after a selection, in growing bins."""
    e = t.hits().groupBy("event_id", "energy").agg(F.bool_or(c.beta > 0.5).alias("k"))
    n = e.groupBy(bin_of(c.energy, LOGS).alias("bin")).agg(F.count("*").alias("n"), F.count_if("k").alias("kept"))
    n = n.withColumn("efficiency", r(F.try_divide("kept", "n")))
    return all_bins(n, LOGS, n).select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept"), "efficiency")


CORRECTIONS = [2, 10, 20, 50, 100, 200]


@query(on_hits(f"SELECT {cases('energy', CORRECTIONS)} AS bin, round(avg(x/energy-1), 6) AS shift, round(stddev_pop(x/energy-1), 6) AS spread FROM hits WHERE energy >= 2 AND energy <= 200 GROUP BY 1"))
def correction_bins(t: Tables) -> DataFrame:
    v = c.x / c.energy - 1
    return t.hits().where("energy between 2 and 200").groupBy(bin_of(c.energy, CORRECTIONS).alias("bin")).agg(r(F.avg(v)).alias("shift"), r(F.stddev_pop(v)).alias("spread"))


@query(on_hits("SELECT round(sum(w*CASE WHEN t_idx >= 0 THEN energy ELSE 0 END)/sum(w*energy), 6) AS purity, round(sum(w*CASE WHEN t_idx >= 0 THEN energy ELSE 0 END)/sum(CASE WHEN t_idx >= 0 THEN energy ELSE 0 END), 6) AS efficiency FROM (SELECT *, 0.5*(1+tanh(10/(0.6+1e-2)*(beta-0.6))) AS w FROM hits)"))
def soft_purity(t: Tables) -> DataFrame:
    """Expected purity and efficiency under a soft threshold."""
    w = 0.5 * (1 + F.tanh(F.lit(10 / (0.6 + 1e-2)) * (c.beta - 0.6)))
    true = F.when(F.col("t_idx") >= 0, c.energy).otherwise(0.0)
    return t.hits().agg(r(F.sum(w * true) / F.sum(w * c.energy)).alias("purity"), r(F.sum(w * true) / F.sum(true)).alias("efficiency"))


@query(on_hits("""SELECT event_id, round(2*p*q/nullif(p+q, 0), 6) AS f_score, round(p, 6) AS prec, round(q, 6) AS recall FROM (SELECT event_id, coalesce(sum(CASE WHEN beta > 0.5 AND t_idx >= 0 THEN energy END)/sum(CASE WHEN beta > 0.5 THEN energy END), 0) AS p,
  coalesce(sum(CASE WHEN beta > 0.5 AND t_idx >= 0 THEN energy END)/sum(CASE WHEN t_idx >= 0 THEN energy END), 0) AS q FROM hits GROUP BY 1)"""))
def scalar_scores(t: Tables) -> DataFrame:
    """Energy-weighted precision, recall and their harmonic mean of each event."""
    s = lambda cond: F.sum(F.when(cond, c.energy))
    kept, true, p, q = c.beta > 0.5, F.col("t_idx") >= 0, F.col("prec"), F.col("recall")
    rows = t.hits().groupBy("event_id").agg(*(F.coalesce(F.try_divide(s(kept & true), s(d)), F.lit(0.0)).alias(n) for n, d in (("prec", kept), ("recall", true))))
    return rows.select("event_id", r(F.try_divide(2 * p * q, p + q)).alias("f_score"), r(p).alias("prec"), r(q).alias("recall"))


CENTRES = "ctr AS (SELECT event_id, t_idx, sum(beta*x)/sum(beta) AS cx, sum(beta*y)/sum(beta) AS cy FROM hits WHERE t_idx >= 0 GROUP BY 1, 2 HAVING sum(beta) > 0)"


@query(on_hits("SELECT event_id, round(avg(CASE WHEN h.t_idx = ctr.t_idx THEN ln(d+1) END), 5) AS att, round(avg(CASE WHEN h.t_idx <> ctr.t_idx THEN exp(-d) END), 6) AS rep FROM (SELECT h.event_id, h.t_idx, ctr.t_idx AS o, ((x-cx)*(x-cx)+(y-cy)*(y-cy))/100 AS d FROM hits h JOIN ctr ON ctr.event_id = h.event_id) h, LATERAL (SELECT o AS t_idx) ctr GROUP BY 1", CENTRES))
def coordinate_loss(t: Tables) -> DataFrame:
    """Pull to an object's weighted centre and push from the others; objects times rows stay inside an event."""
    hits = t.hits()
    ctr = hits.where("t_idx >= 0").groupBy("event_id", F.col("t_idx").alias("o")).agg(F.sum("beta").alias("w"), F.sum(c.beta * c.x).alias("cx"), F.sum(c.beta * F.col("y")).alias("cy")).where("w > 0")
    both = hits.join(ctr, "event_id")
    dx, dy = c.x - F.col("cx") / F.col("w"), F.col("y") - F.col("cy") / F.col("w")
    d, own = (dx * dx + dy * dy) / 100, F.col("t_idx") == F.col("o")
    return both.groupBy("event_id").agg(r(F.avg(F.when(own, F.log(d + 1))), 5).alias("att"), r(F.avg(F.when(~own, F.exp(-d)))).alias("rep"))


@query(on_edges("SELECT event_id, hit_id, nbr_id, CASE WHEN rn = 1 THEN 1 ELSE 0 END AS target FROM (SELECT e.event_id, e.hit_id, e.nbr_id, row_number() OVER (PARTITION BY e.event_id, e.hit_id ORDER BY dsq, e.nbr_id) AS rn FROM edges e JOIN hits a USING (event_id, hit_id) JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id WHERE slot > 0 AND a.t_idx = b.t_idx AND a.t_idx >= 0)"))
def edge_targets(t: Tables) -> DataFrame:
    """Same-truth edges; the closest one of a row is its target."""
    e = ed.with_neighbour(ed.with_own(kn.knn(t.hits(), K, carry=("t_idx",)).where("slot > 0"), t.hits(), "t_idx"), t.hits(), "t_idx").where("t_idx >= 0 and t_idx = n_t_idx")
    w = Window.partitionBy(*KEY).orderBy("dsq", "nbr_id")
    return e.select(*KEY, "nbr_id", F.when(F.row_number().over(w) == 1, 1).otherwise(0).alias("target"))


@query(on_hits("SELECT event_id, t_idx, row_number() OVER (PARTITION BY event_id ORDER BY v DESC, t_idx) AS place FROM (SELECT event_id, t_idx, floor(sum(energy*z)/sum(energy)*1e6+0.5001) AS v FROM hits WHERE t_idx >= 0 GROUP BY 1, 2)"))
def weighted_order(t: Tables) -> DataFrame:
    """Objects of an event by their weighted coordinate, highest first."""
    o = t.hits().where("t_idx >= 0").groupBy("event_id", "t_idx").agg(r(F.sum(c.energy * c.z) / F.sum("energy")).alias("v"))
    return o.select("event_id", "t_idx", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("v"), "t_idx")).cast("long").alias("place"))


@query(on_hits("SELECT event_id, round(sum((CASE WHEN hit_id = 1 THEN 1 ELSE 0.3 END)*pow(0.7, n-hit_id)*x), 5) AS ema FROM (SELECT *, count(*) OVER (PARTITION BY event_id) AS n FROM hits) GROUP BY 1"))
def exponential_average(t: Tables) -> DataFrame:
    """The last value of each event's running average with memory: a scan of affine maps, part by part."""
    first = F.col("hit_id") == 1
    rows = sc.affine_scan(t.hits().select(*KEY, "x"), "hit_id", F.when(first, 0.0).otherwise(0.7), F.when(first, F.col("x")).otherwise(0.3 * F.col("x")), "ema")
    return rows.groupBy("event_id").agg(r(F.max_by("ema", "hit_id"), 5).alias("ema"))


@query(on_edges("SELECT event_id, hit_id, round(sum(w*nx)/sum(w)-max(CASE WHEN slot = 0 THEN nx END), 5) AS shift FROM (SELECT e.*, b.x AS nx, greatest(exp(-10*dsq/1000), 0)+1e-6 AS w FROM edges e JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id) GROUP BY 1, 2"))
def weighted_neighbour_means(t: Tables) -> DataFrame:
    """A row's weighted mean over its neighbours, less its own value."""
    e = ed.with_neighbour(kn.knn(t.hits(), K, carry=("x",)), t.hits(), "x")
    w = F.exp(-10 * F.col("dsq") / 1000) + 1e-6
    return e.groupBy(*KEY).agg(r(F.sum(w * F.col("n_x")) / F.sum(w) - F.max(F.when(F.col("slot") == 0, F.col("n_x"))), 5).alias("shift"))


@query(on_edges("SELECT event_id, hit_id, nbr_id, round(sum(dsq) OVER w, 5) AS total, round(max(dsq) OVER w, 5) AS top FROM edges WINDOW w AS (PARTITION BY event_id, hit_id)"))
def edge_mix(t: Tables) -> DataFrame:
    """Sum and maximum over a row's edges on each of them."""
    w = Window.partitionBy(*KEY)
    return kn.knn(t.hits(), K).select(*KEY, "nbr_id", r(F.sum("dsq").over(w), 5).alias("total"), r(F.max("dsq").over(w), 5).alias("top"))


@query(on_edges("SELECT e.event_id, round(avg(CASE WHEN a.t_idx = b.t_idx AND a.t_idx >= 0 THEN dsq/100 ELSE greatest(0, 1-sqrt(dsq)/10) END), 5) AS loss FROM edges e JOIN hits a USING (event_id, hit_id) JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id WHERE slot > 0 GROUP BY 1"))
def push_pull_loss(t: Tables) -> DataFrame:
    """Neighbours of one object are pulled together, others pushed to a margin."""
    e = ed.with_neighbour(ed.with_own(kn.knn(t.hits(), K, carry=("t_idx",)).where("slot > 0"), t.hits(), "t_idx"), t.hits(), "t_idx")
    same = (F.col("t_idx") == F.col("n_t_idx")) & (F.col("t_idx") >= 0)
    return e.groupBy("event_id").agg(r(F.avg(F.when(same, F.col("dsq") / 100).otherwise(F.greatest(F.lit(0.0), 1 - F.sqrt("dsq") / 10))), 5).alias("loss"))


@query(on_hits("SELECT event_id, hit_id AS kept FROM alphas JOIN (SELECT event_id, rk AS pt, hit_id FROM cand) USING (event_id, pt)", GREEDY.replace("(10+5*a.beta)*(10+5*a.beta)", "144.0"), ALPHAS))
def threshold_collection(t: Tables) -> DataFrame:
    """Rows in descending score, less those within a radius of one that is kept."""
    return co.condense(t.hits(), "beta", 12.0, 0.3, max_beta=True).where("hit_id = alpha_id").select("event_id", F.col("hit_id").alias("kept"))


@query("SELECT DISTINCT event_type FROM events")
def experiment_list(t: Tables) -> DataFrame:
    return t.table("events").select("event_type").distinct()
