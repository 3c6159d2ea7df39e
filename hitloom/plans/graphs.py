"""Queries of neighbour joins, edge aggregates and gathers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.operators import edges as ed
from hitloom.operators import knn as kn
from hitloom.plans.registry import K, on_edges, on_hits, query, r
from hitloom.sources.tables import DSQ, Tables, edges_sql

KEY = ["event_id", "hit_id"]
EDGE = "SELECT event_id, hit_id, nbr_id, slot, round(dsq, 5) AS dsq FROM edges"


def slot() -> Column:
    return F.col("slot").cast("long").alias("slot")


def shown(edges: DataFrame) -> DataFrame:
    return edges.select(*KEY, "nbr_id", slot(), r("dsq", 5).alias("dsq"))


def edges(t: Tables, *carry: str) -> DataFrame:
    """Neighbour edges that carry columns of both ends."""
    return kn.knn(t.hits(), K, carry=carry)


@query(on_edges(EDGE))
def knn_exact(t: Tables) -> DataFrame:
    return shown(edges(t))


@query(on_hits(EDGE + " WHERE dsq <= 64", edges_sql(8)))
def knn_within_radius(t: Tables) -> DataFrame:
    return shown(kn.knn(t.hits(), 8, max_radius=8.0))


def _masked(probe: str, other: str) -> str:
    on = f"a.event_id = b.event_id AND ({probe}) AND (a.hit_id = b.hit_id OR ({other}))"
    return on_hits(EDGE, edges_sql(K, on))


@query(_masked("a.beta < 0.5", "b.beta >= 0.5"))
def knn_masked_scat_xor(t: Tables) -> DataFrame:
    """Rows below the mask threshold find rows above it."""
    return shown(kn.knn(t.hits(), K, probes=F.col("beta") < 0.5, neighbours=F.col("beta") >= 0.5))


@query(_masked("a.beta >= 0.5", "b.beta < 0.5"))
def knn_masked_acc_xor(t: Tables) -> DataFrame:
    return shown(kn.knn(t.hits(), K, probes=F.col("beta") >= 0.5, neighbours=F.col("beta") < 0.5))


@query(_masked("a.beta >= 0.5", "b.beta >= 0.5"))
def knn_masked_and(t: Tables) -> DataFrame:
    return shown(kn.knn(t.hits(), K, probes=F.col("beta") >= 0.5, neighbours=F.col("beta") >= 0.5))


@query(_masked("TRUE", "b.is_track"))
def knn_directed(t: Tables) -> DataFrame:
    """All rows ask; only tracks are found (besides self)."""
    return shown(kn.knn(t.hits(), K, neighbours=F.col("is_track")))


@query(on_edges(EDGE))
def knn_grid(t: Tables) -> DataFrame:
    """Exact neighbours through grid cells, ring by ring until they are proven."""
    return shown(kn.knn_grid(t.hits(), K, 12.0))


@query(on_hits(EDGE, edges_sql(8)))
def knn_grid_by_statistics(t: Tables) -> DataFrame:
    """The cell width follows the sizes and ranges of events."""
    return shown(kn.knn_grid(t.hits(), 8))


RING = "a.event_id = b.event_id AND abs(floor(a.x/12) - floor(b.x/12)) <= 1 AND abs(floor(a.y/12) - floor(b.y/12)) <= 1"


@query(on_hits(EDGE, edges_sql(K, RING)))
def knn_single_ring(t: Tables) -> DataFrame:
    return shown(kn.knn_single_ring(t.hits(), K, 12.0))


WARP = "pow((1+a.beta)*(a.x-b.x)+0.1*(a.y-b.y),2)+pow(0.2*(a.x-b.x)+(1-a.tax)*(a.y-b.y),2)"


@query(on_hits("SELECT event_id, hit_id, nbr_id, slot, round(dsq, 5) AS dsq FROM edges", edges_sql(K, dsq=WARP)))
def knn_warped(t: Tables) -> DataFrame:
    """Each probe measures in its own linear map, so distances are not symmetric."""
    m = [[1 + F.col("beta"), F.lit(0.2)], [F.lit(0.1), 1 - F.col("tax")]]
    return kn.knn_warped(t.hits(), K, m, ("x", "y")).select(*KEY, "nbr_id", slot(), r("dsq", 5).alias("dsq"))


@query(on_hits("""SELECT r.event_id, r.hit_id, 5 - coalesce(s.same, 0) AS mismatches FROM (SELECT DISTINCT event_id, hit_id FROM edges) r LEFT JOIN (SELECT event_id, hit_id, count(*) AS same
  FROM edges JOIN ring USING (event_id, hit_id, nbr_id) GROUP BY event_id, hit_id) s USING (event_id, hit_id)""", edges_sql(K), edges_sql(K, RING, "ring")))
def compare_knn(t: Tables) -> DataFrame:
    return kn.mismatches(edges(t), kn.knn_single_ring(t.hits(), K, 12.0), K)


@query(on_edges("SELECT e.event_id, e.hit_id, nbr_id, slot, round((a.x-b.x)*(a.x-b.x), 5) AS dx2 FROM edges e JOIN hits a USING (event_id, hit_id) JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id"))
def local_distance(t: Tables) -> DataFrame:
    """Squared distance along given edges in another space."""
    e = ed.with_neighbour(ed.with_own(edges(t, "x"), t.hits(), "x"), t.hits(), "x")
    return e.select(*KEY, "nbr_id", slot(), r((F.col("x") - F.col("n_x")) * (F.col("x") - F.col("n_x")), 5).alias("dx2"))


NB = "edges e JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id"


@query(on_edges(f"SELECT e.event_id, e.hit_id, round(sum(exp(-dsq)*b.energy)/5, 5) AS mean, round(max(exp(-dsq)*b.energy), 5) AS max FROM {NB} GROUP BY 1, 2"))
def accumulate_mean_max(t: Tables) -> DataFrame:
    return ed.accumulate(edges(t, "energy"), t.hits(), "energy", K).select(*KEY, r("mean", 5).alias("mean"), r("max", 5).alias("max"))


@query(on_edges(f"SELECT e.event_id, e.hit_id, round(sum(b.energy/(1+dsq))/5, 5) AS mean, round(max(b.energy/(1+dsq)), 5) AS max, arg_max(nbr_id, (b.energy/(1+dsq), -nbr_id)) AS arg FROM {NB} GROUP BY 1, 2"))
def accumulate_linear(t: Tables) -> DataFrame:
    """Mean and greatest value under weights of their own, and the neighbour that has it."""
    return ed.accumulate(edges(t, "energy"), t.hits(), "energy", K, 1 / (1 + F.col("dsq"))).select(*KEY, r("mean", 5).alias("mean"), r("max", 5).alias("max"), "arg")


@query(on_edges(f"SELECT e.event_id, e.hit_id, round(sum(exp(-dsq)*b.energy)/sum(exp(-dsq)), 5) AS v FROM {NB} GROUP BY 1, 2"))
def accumulate_normalised(t: Tables) -> DataFrame:
    e = ed.with_neighbour(edges(t, "energy"), t.hits(), "energy")
    w = F.exp(-F.col("dsq"))
    return e.groupBy(*KEY).agg(r(F.coalesce(F.try_divide(F.sum(w * F.col("n_energy")), F.sum(w)), F.lit(0.0)), 5).alias("v"))


@query(on_edges(f"SELECT e.event_id, e.hit_id, round(min(b.x), 5) AS lo, round(avg(b.x), 5) AS mean, round(max(b.x), 5) AS hi, round(sum(b.x), 5) AS total FROM {NB} GROUP BY 1, 2"))
def accumulate_modes(t: Tables) -> DataFrame:
    e = ed.with_neighbour(edges(t, "x"), t.hits(), "x").groupBy(*KEY)
    x = F.col("n_x")
    return e.agg(r(F.min(x), 5).alias("lo"), r(F.avg(x), 5).alias("mean"), r(F.max(x), 5).alias("hi"), r(F.sum(x), 5).alias("total"))


@query(on_edges("""SELECT h.event_id, h.hit_id, round(coalesce(p, 0), 5) AS pushed FROM hits h LEFT JOIN (SELECT e.event_id, nbr_id, sum(energy/(1+dsq)) AS p
  FROM edges e JOIN hits a USING (event_id, hit_id) WHERE slot > 0 GROUP BY 1, 2) s ON s.event_id = h.event_id AND s.nbr_id = h.hit_id"""))
def push_sum(t: Tables) -> DataFrame:
    return ed.push_sum(edges(t, "energy").where("slot > 0"), t.hits(), "energy", 1 / (1 + F.col("dsq"))).select(*KEY, r("pushed", 5).alias("pushed"))


@query(on_edges(f"""SELECT c.event_id, c.hit_id, round(c.mx, 5) AS m_x, round(c.my, 5) AS m_y, round(sum(b.energy*(b.x-mx)*(b.x-mx))/(sum(b.energy)+1e-4), 3) AS cov_xx,
  round(sum(b.energy*(b.y-my)*(b.x-mx))/(sum(b.energy)+1e-4), 3) AS cov_yx, round(sum(b.energy*(b.y-my)*(b.y-my))/(sum(b.energy)+1e-4), 3) AS cov_yy
  FROM {NB} JOIN (SELECT e.event_id, e.hit_id, sum(b.energy*b.x)/(sum(b.energy)+1e-4) AS mx, sum(b.energy*b.y)/(sum(b.energy)+1e-4) AS my FROM {NB} GROUP BY 1, 2) c
  ON c.event_id = e.event_id AND c.hit_id = e.hit_id GROUP BY c.event_id, c.hit_id, c.mx, c.my"""))
def neighbour_covariance(t: Tables) -> DataFrame:
    c = ed.covariance(edges(t, "energy", "x", "y"), t.hits(), "energy", ("x", "y"))
    return c.select(*KEY, r("m_x", 5).alias("m_x"), r("m_y", 5).alias("m_y"), *(r(f"cov_{p}", 3).alias(f"cov_{p}") for p in ("xx", "yx", "yy")))


@query(on_edges("SELECT e.event_id, e.hit_id, nbr_id, slot, round(a.x-b.x, 5) AS dx, round(a.energy-b.energy, 5) AS de FROM edges e JOIN hits a USING (event_id, hit_id) JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id WHERE slot > 0"))
def edge_features(t: Tables) -> DataFrame:
    e = ed.with_neighbour(ed.with_own(edges(t, "x", "energy").where("slot > 0"), t.hits(), "x", "energy"), t.hits(), "x", "energy")
    return e.select(*KEY, "nbr_id", slot(), r(F.col("x") - F.col("n_x"), 5).alias("dx"), r(F.col("energy") - F.col("n_energy"), 5).alias("de"))


@query(on_edges("""SELECT event_id, hit_id, nbr_id, slot, round(exp(-dsq/100-m)/sum(exp(-dsq/100-m)) OVER (PARTITION BY event_id, hit_id), 6) AS weight,
  round(sum(dsq) OVER (PARTITION BY event_id, hit_id), 5) AS total, round(max(dsq) OVER (PARTITION BY event_id, hit_id), 5) AS far FROM (SELECT *, max(-dsq/100) OVER (PARTITION BY event_id, hit_id) AS m FROM edges)"""))
def edge_softmax(t: Tables) -> DataFrame:
    w = Window.partitionBy(*KEY)
    e = ed.softmax(edges(t), -F.col("dsq") / 100)
    return e.select(*KEY, "nbr_id", slot(), r("weight").alias("weight"), r(F.sum("dsq").over(w), 5).alias("total"), r(F.max("dsq").over(w), 5).alias("far"))


@query(on_edges("""SELECT event_id, hit_id, nbr_id, row_number() OVER (PARTITION BY event_id, hit_id ORDER BY (slot > 0), s DESC, nbr_id) - 1 AS slot FROM (SELECT e.event_id, e.hit_id, nbr_id, slot, b.beta AS s, dsq
  FROM edges e JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id) WHERE dsq <= 100 QUALIFY row_number() OVER (PARTITION BY event_id, hit_id ORDER BY (slot > 0), s DESC, nbr_id) <= 3"""))
def sort_and_select_neighbours(t: Tables) -> DataFrame:
    """Edges ordered by a score, self first, cut at three and at a squared radius."""
    e = ed.with_neighbour(edges(t, "beta"), t.hits(), "beta").where("dsq <= 100")
    w = Window.partitionBy(*KEY).orderBy(F.col("slot") > 0, F.desc("n_beta"), "nbr_id")
    return e.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select(*KEY, "nbr_id", (F.col("rn") - 1).cast("long").alias("slot"))


@query(on_edges("SELECT e.event_id, e.hit_id, nbr_id, slot FROM edges e JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id WHERE slot = 0 OR b.beta >= 0.5"))
def edge_selector(t: Tables) -> DataFrame:
    e = ed.with_neighbour(edges(t, "beta"), t.hits(), "beta")
    return e.where("slot = 0 OR n_beta >= 0.5").select(*KEY, "nbr_id", slot())


@query(on_edges(f"SELECT e.event_id, e.hit_id, round(sum(CASE WHEN b.t_idx = a.t_idx THEN b.energy ELSE 0 END)/sum(b.energy), 6) AS same, CASE WHEN sum(CASE WHEN b.t_idx = a.t_idx THEN b.energy ELSE 0 END)/sum(b.energy) <= 0.4 THEN -1 ELSE a.t_idx END AS t_idx FROM {NB} JOIN hits a ON a.event_id = e.event_id AND a.hit_id = e.hit_id GROUP BY e.event_id, e.hit_id, a.t_idx"))
def same_truth_fraction(t: Tables) -> DataFrame:
    """Share of the neighbours' energy with the row's own label; rows with little of it become noise."""
    e = ed.with_neighbour(ed.with_own(edges(t, "t_idx", "energy"), t.hits(), "t_idx"), t.hits(), "t_idx", "energy")
    share = F.sum(F.when(F.col("n_t_idx") == F.col("t_idx"), F.col("n_energy")).otherwise(0.0)) / F.sum("n_energy")
    return e.groupBy(*KEY, "t_idx").agg(share.alias("s")).select(*KEY, r("s").alias("same"), F.when(F.col("s") <= 0.4, -1).otherwise(F.col("t_idx")).alias("t_idx"))


@query(on_edges(f"""SELECT event_id, hit_id, t AS label, n FROM (SELECT *, row_number() OVER (PARTITION BY event_id, hit_id ORDER BY n DESC, t) AS rn FROM (SELECT e.event_id, e.hit_id, b.t_idx AS t, count(*) AS n FROM {NB} GROUP BY 1, 2, 3)) WHERE rn = 1 AND n >= 3"""))
def majority_label(t: Tables) -> DataFrame:
    n = ed.with_neighbour(edges(t, "t_idx"), t.hits(), "t_idx").groupBy(*KEY, F.col("n_t_idx").alias("label")).agg(F.count("*").alias("n"))
    return n.groupBy(*KEY).agg(F.max_by(F.struct("label", "n"), F.struct(F.col("n"), -F.col("label"))).alias("m")).select(*KEY, "m.*").where("n >= 3")


@query(on_edges(f"SELECT e.event_id, e.hit_id, nbr_id, slot FROM {NB} JOIN hits a ON a.event_id = e.event_id AND a.hit_id = e.hit_id WHERE slot = 0 OR a.beta >= (SELECT max(c.beta) FROM edges f JOIN hits c ON c.event_id = f.event_id AND c.hit_id = f.nbr_id WHERE f.event_id = e.event_id AND f.hit_id = e.hit_id AND f.slot > 0)"))
def directed_graph_filter(t: Tables) -> DataFrame:
    """Rows whose neighbours score higher lose all neighbours."""
    rows = kn.lists(t.hits(), K, carry=("beta",))
    # Self stands first.
    top = F.array_max(F.slice("near.n_beta", 2, K))
    kept = F.when(F.col("beta") >= top, F.col("near")).otherwise(F.slice("near", 1, 1))
    return kn.exploded(rows.withColumn("near", kept)).select(*KEY, "nbr_id", slot())


UP = "ups AS (SELECT event_id, hit_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY beta DESC, hit_id) AS rn FROM hits) WHERE beta > 0.8 OR rn = 1)"
DOWN = f"""down AS (SELECT *, exp(-dsq/100-m)/sum(exp(-dsq/100-m)) OVER (PARTITION BY event_id, hit_id) AS weight FROM (SELECT *, max(-dsq/100) OVER (PARTITION BY event_id, hit_id) AS m FROM (SELECT *, row_number() OVER (PARTITION BY event_id, hit_id ORDER BY dsq, up_id) AS rn
  FROM (SELECT a.event_id, a.hit_id, b.hit_id AS up_id, {DSQ} AS dsq FROM hits a JOIN hits b ON a.event_id = b.event_id JOIN ups u ON u.event_id = b.event_id AND u.hit_id = b.hit_id)) WHERE rn <= 3))"""


#: Squared distance by which weights of up nodes fall to 1 / e.
SCALE = 100.0


def transition(hits: DataFrame, k: int = 3, threshold: float = 0.8, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's k nearest up nodes (score above threshold, one an event at least) as a list, see knn.lists."""
    w = Window.partitionBy("event_id").orderBy(F.desc("beta"), "hit_id")
    marked = hits.withColumn("up", (F.col("beta") > threshold) | (F.row_number().over(w) == 1))
    return kn.lists(marked, k, neighbours=F.col("up"), own="found", carry=carry)


def down_edges(rows: DataFrame, *keep: str) -> DataFrame:
    """Edges of transition() with their softmax weights."""
    return ed.softmax_edges(rows, SCALE, *keep).withColumnRenamed("nbr_id", "up_id")


@query(on_hits("SELECT event_id, hit_id, up_id, round(dsq, 5) AS dsq, round(weight, 6) AS weight FROM down", UP, DOWN))
def graph_condensation_edges(t: Tables) -> DataFrame:
    return down_edges(transition(t.hits())).select(*KEY, "up_id", r("dsq", 5).alias("dsq"), r("weight").alias("weight"))


@query(on_hits("SELECT d.event_id, up_id, round(sum(weight*energy), 5) AS pushed, round(sum(weight*energy)/sum(weight), 5) AS mean FROM down d JOIN hits USING (event_id, hit_id) GROUP BY 1, 2", UP, DOWN))
def push_up(t: Tables) -> DataFrame:
    """Sum and mean of the rows below each up node."""
    d = down_edges(transition(t.hits(), carry=("energy",)), "energy")
    s = F.sum(F.col("weight") * F.col("energy"))
    return d.groupBy("event_id", "up_id").agg(r(s, 5).alias("pushed"), r(s / F.sum("weight"), 5).alias("mean"))


@query(on_hits("SELECT d.event_id, d.hit_id, round(sum(weight*u.energy), 5) AS mean, round(max(u.energy), 5) AS max, arg_max(up_id, weight) AS gather FROM down d JOIN hits u ON u.event_id = d.event_id AND u.hit_id = d.up_id WHERE d.rn = 1 OR d.dsq > 0 GROUP BY 1, 2", UP, DOWN))
def pull_down(t: Tables) -> DataFrame:
    """Weighted mean and maximum of the up nodes of each row, and the node with the largest weight."""
    near = F.col("near")
    first = near[0]["nbr_id"]
    # Only the nearest one counts where distances are 0. It weighs most, too.
    counts = lambda n: (n["dsq"] > 0) | (n["nbr_id"] == first)
    mean = ed.softmax_sum(near, lambda n: F.when(counts(n), n["n_energy"]).otherwise(0.0), SCALE)
    top = F.array_max(F.transform(F.filter(near, counts), lambda n: n["n_energy"]))
    return transition(t.hits(), carry=("energy",)).select(*KEY, r(mean, 5).alias("mean"), r(top, 5).alias("max"), first.alias("gather"))


@query(on_hits("SELECT h.event_id, h.hit_id, round(coalesce(b.energy, -1), 6) AS v FROM hits h LEFT JOIN hits b ON b.event_id = h.event_id AND b.hit_id = h.hit_id + 7"))
def select_with_default(t: Tables) -> DataFrame:
    """Gather by index, with a default where the index points nowhere."""
    far = t.hits().select("event_id", (F.col("hit_id") - 7).alias("hit_id"), "energy")
    return t.hits().select(*KEY).join(far, KEY, "left").select(*KEY, r(F.coalesce("energy", F.lit(-1.0))).alias("v"))


@query(on_hits("SELECT h.event_id, h.hit_id, CASE WHEN t_idx < 0 THEN t_idx ELSE coalesce(m.new_id, -2) END AS new_idx FROM hits h LEFT JOIN (SELECT event_id, t_idx AS old, CAST(min(hit_id) AS INTEGER) AS new_id FROM hits WHERE beta > 0.3 GROUP BY 1, 2) m ON m.event_id = h.event_id AND m.old = h.t_idx"))
def index_replacer(t: Tables) -> DataFrame:
    """Indices through a map; negative ones pass."""
    hits = t.hits()
    m = hits.where("beta > 0.3").groupBy("event_id", "t_idx").agg(F.min("hit_id").cast("int").alias("new_id"))
    return hits.join(m, ["event_id", "t_idx"], "left").select(*KEY, F.when(F.col("t_idx") < 0, F.col("t_idx")).otherwise(F.coalesce("new_id", F.lit(-2))).alias("new_idx"))


@query(on_hits("SELECT a.event_id, count(*) AS pairs, sum(CASE WHEN pow(a.x-b.x,2)+pow(a.y-b.y,2) < 4 THEN 1 ELSE 0 END)::BIGINT AS close_xy FROM hits a JOIN hits b ON a.event_id = b.event_id AND a.hit_id < b.hit_id AND pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(0.1*(a.z-b.z),2) < 25 GROUP BY 1"))
def close_pairs(t: Tables) -> DataFrame:
    c = ("x", "y", "z")
    p = kn.close(t.hits(), 5.0, c)

    def sq(a: str, scale: float = 1.0) -> Column:
        return F.pow(scale * (F.col(f"p_{a}") - F.col(f"n_{a}")), 2.0)

    p = p.where(sq("x") + sq("y") + sq("z", 0.1) < 25)
    return p.groupBy("event_id").agg(F.count("*").alias("pairs"), F.count_if(sq("x") + sq("y") < 4).alias("close_xy"))
