"""Queries of clustering in all its modes, of what follows from it, and of the whole analysis.

SQL repeats the sequential rules as recursive tables: which rows become points does not depend on who takes
a row over, so one recursion finds the points of an event and a second one follows each row through them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions.columns import c
from hitloom.operators import condense as co
from hitloom.operators import groups as gr
from hitloom.operators import knn as kn
from hitloom.operators import matching as ma
from hitloom.plans.metrics import bin_of, cases
from hitloom.operators import select as sel
from hitloom.plans.objects import ALPHAS, GREEDY, IOU, PAGE, condensed, predicted
from hitloom.plans.registry import K, on_edges, on_hits, query, r
from hitloom.sources.tables import Tables

KEY = ["event_id", "hit_id"]

# Each row through the points that cover it, in their order: a later one takes it over by the scaled distance.
TAKEN = """met AS (SELECT event_id, hit_id, sid, alpha_id, d, r2, row_number() OVER (PARTITION BY event_id, hit_id ORDER BY sid) AS k FROM cover JOIN alphas USING (event_id, pt)),
  fold AS (WITH RECURSIVE walk(event_id, hit_id, k, sid, alpha_id, stored) AS (
    SELECT event_id, hit_id, k, sid, alpha_id, d FROM met WHERE k = 1
    UNION ALL SELECT w.event_id, w.hit_id, m.k, CASE WHEN w.stored * m.r2 >= m.d THEN m.sid ELSE w.sid END, CASE WHEN w.stored * m.r2 >= m.d THEN m.alpha_id ELSE w.alpha_id END, CASE WHEN w.stored * m.r2 >= m.d THEN m.d ELSE w.stored END
    FROM walk w JOIN met m ON m.event_id = w.event_id AND m.hit_id = w.hit_id AND m.k = w.k + 1)
    SELECT event_id, hit_id, arg_max(sid, k) AS sid, arg_max(alpha_id, k) AS alpha_id FROM walk GROUP BY 1, 2),
  assigned AS (SELECT h.event_id, h.hit_id, CAST(coalesce(f.sid, -1) AS BIGINT) AS sid, f.alpha_id FROM hits h LEFT JOIN fold f USING (event_id, hit_id))"""


def on_assigned(body: str, *more: str) -> str:
    return on_hits(body, GREEDY, ALPHAS, TAKEN, *more)


def longs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sid", F.col("sid").cast("long"))


@query(on_assigned("SELECT * FROM assigned"))
def condense_default(t: Tables) -> DataFrame:
    """Density peaks; later points may take rows over."""
    return longs(condensed(t, False))


KEPT = """numbered AS (SELECT event_id, hit_id, sid, alpha_id, sum(CASE WHEN sid < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY hit_id)::BIGINT AS before, sum(CASE WHEN sid < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_id)::BIGINT AS noise FROM assigned)"""


@query(on_assigned("SELECT event_id, hit_id, CASE WHEN sid < 0 THEN before - 1 ELSE sid + noise END AS sid, coalesce(alpha_id, hit_id) AS alpha_id FROM numbered", KEPT))
def condense_keep_noise(t: Tables) -> DataFrame:
    """Rows that no point takes become objects of their own, numbered first."""
    return longs(condensed(t, False, True))


@query(on_hits("""SELECT h.event_id, h.hit_id, CASE WHEN h.is_track THEN h.hit_id ELSE f.alpha_id END AS alpha_id FROM hits h LEFT JOIN (SELECT event_id, hit_id, arg_min(alpha_id, sid) AS alpha_id FROM cover JOIN alphas USING (event_id, pt) GROUP BY 1, 2) f USING (event_id, hit_id)""",
  GREEDY.replace("FROM hits)", "FROM hits WHERE NOT is_track)"), ALPHAS.replace("FROM hits GROUP BY", "FROM cand GROUP BY")))
def condense_singletons(t: Tables) -> DataFrame:
    """Tracks are objects of their own: they neither take rows nor are taken."""
    rows = co.condense(t.hits(), "beta", 10 + 5 * c.beta, 0.3, max_beta=True, singletons=F.col("is_track"))
    return rows.select(*KEY, "alpha_id")


@query(on_hits("""SELECT h.event_id, h.hit_id, CAST(coalesce(f.sid, -1) AS BIGINT) AS sid FROM hits h LEFT JOIN (SELECT event_id, hit_id, min(sid) AS sid FROM cover JOIN alphas USING (event_id, pt) GROUP BY 1, 2) f USING (event_id, hit_id)""",
  GREEDY.replace("(10+5*a.beta)*(10+5*a.beta)", "(12*(0.5+a.tax))*(12*(0.5+a.tax))"), ALPHAS))
def condense_local_distance(t: Tables) -> DataFrame:
    """Each point's radius is its own distance scale times a threshold."""
    return longs(co.condense_scaled(t.hits(), F.col("tax") + 0.5, 12.0, 0.3, max_beta=True)).select(*KEY, "sid")


@query(on_assigned(f"SELECT event_id, slot, page, array_to_string(list(hit_id ORDER BY hit_id), ',') AS members, count(*) AS n FROM (SELECT *, sid + 1 AS slot, (row_number() OVER (PARTITION BY event_id, sid ORDER BY hit_id) - 1) // {PAGE} AS page FROM assigned) GROUP BY 1, 2, 3"))
def ragged_members(t: Tables) -> DataFrame:
    """The rows of each object, noise as object 0, in pages of fixed length."""
    rows = condensed(t, False).select("event_id", (F.col("sid") + 1).cast("long").alias("slot"), "hit_id")
    return sel.paged(rows, ["event_id", "slot"], "hit_id", PAGE, "m").select("event_id", "slot", "page", F.array_join("m", ",").alias("members"), "n")


@query(on_assigned("""SELECT event_id, hit_id, sid + 1 AS slot, coalesce(alpha_id, max(CASE WHEN sid < 0 THEN hit_id END) OVER (PARTITION BY event_id)) AS representative,
  dense_rank() OVER (PARTITION BY event_id ORDER BY sid) - 1 AS ragged FROM assigned"""))
def alpha_maps(t: Tables) -> DataFrame:
    """Each object's alpha (noise: its last row), and the maps from rows to objects and back."""
    return co.alpha_maps(condensed(t, False)).select(*KEY, F.col("slot").cast("long").alias("slot"), "representative", F.col("ragged").cast("long").alias("ragged"))


@query(on_assigned("SELECT a.event_id, a.hit_id, round(CASE WHEN a.alpha_id IS NULL THEN h.x ELSE b.x END, 5) AS x, round(CASE WHEN a.alpha_id IS NULL THEN h.energy ELSE b.energy END, 5) AS energy FROM assigned a JOIN hits h USING (event_id, hit_id) LEFT JOIN hits b ON b.event_id = a.event_id AND b.hit_id = a.alpha_id"))
def condense_full_width(t: Tables) -> DataFrame:
    """The alpha's features on all rows of its object; noise keeps its own."""
    hits = t.hits().select(*KEY, "x", "energy")
    top = hits.select("event_id", F.col("hit_id").alias("alpha_id"), F.col("x").alias("ax"), F.col("energy").alias("ae"))
    rows = condensed(t, False).join(hits, KEY).join(top, ["event_id", "alpha_id"], "left")
    return rows.select(*KEY, r(F.coalesce("ax", "x"), 5).alias("x"), r(F.coalesce("ae", "energy"), 5).alias("energy"))


@query(on_assigned("SELECT event_id, hit_id, sid FROM assigned WHERE hit_id = alpha_id"))
def alphas_only(t: Tables) -> DataFrame:
    return longs(condensed(t, False)).where("hit_id = alpha_id").select(*KEY, "sid")


@query(on_assigned("SELECT event_id, hit_id, CASE WHEN sid >= 0 THEN 0 ELSE 1 END AS is_noise FROM assigned"))
def noise_flag(t: Tables) -> DataFrame:
    return condensed(t, False).select(*KEY, (F.col("sid") < 0).cast("int").alias("is_noise"))


@query(on_assigned("""SELECT a.event_id, a.sid, max(a.alpha_id) AS alpha_id, count(*) AS n, round(sum(h.energy), 5) AS energy, round(max(CASE WHEN a.hit_id = a.alpha_id THEN h.beta END), 6) AS alpha_beta,
  round(max(CASE WHEN a.hit_id = a.alpha_id THEN h.x END), 5) AS pos_x, round(max(CASE WHEN a.hit_id = a.alpha_id THEN h.y END), 5) AS pos_y, round(max(CASE WHEN a.hit_id = a.alpha_id THEN h.tax END), 5) AS q_low,
  max(CASE WHEN a.hit_id = a.alpha_id THEN h.cls END) AS cls, round(sum(CASE WHEN h.is_track THEN h.energy ELSE 0 END), 5) AS track_momentum, round(sum(h.energy) * max(CASE WHEN a.hit_id = a.alpha_id THEN 1 + h.tax END), 8) AS corrected
  FROM assigned a JOIN hits h USING (event_id, hit_id) WHERE a.sid >= 0 GROUP BY 1, 2"""))
def condensate_objects(t: Tables) -> DataFrame:
    """Objects of the default clustering: size, energy, track momentum, and the alpha's own values."""
    rows = longs(condensed(t, False)).join(t.hits(), KEY).where("sid >= 0")

    def own(x) -> Column:
        return F.max(F.when(F.col("hit_id") == F.col("alpha_id"), x))

    return rows.groupBy("event_id", "sid").agg(
        F.max("alpha_id").alias("alpha_id"), F.count("*").alias("n"), r(F.sum("energy"), 5).alias("energy"), r(own(c.beta)).alias("alpha_beta"), r(own(c.x), 5).alias("pos_x"), r(own(c.y), 5).alias("pos_y"),
        r(own(F.col("tax")), 5).alias("q_low"), own(F.col("cls")).alias("cls"), r(F.sum(F.when(F.col("is_track"), c.energy).otherwise(0.0)), 5).alias("track_momentum"), r(F.sum("energy") * own(1 + F.col("tax")), 8).alias("corrected"),
    )


# The centre of a row is the first centre, in order of score, that it is or is a neighbour of.
LOCAL = """cand AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY beta DESC, hit_id) AS rk FROM hits),
  cover AS (SELECT e.event_id, a.rk AS pt, b.rk AS other, b.hit_id, a.hit_id AS alpha_id FROM edges e JOIN cand a ON a.event_id = e.event_id AND a.hit_id = e.hit_id JOIN cand b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id WHERE e.slot = 0 OR {cond})"""
LOCAL_ALPHAS = ALPHAS.replace("k.beta > 0.3 AND", "")


def centres_sql(cond: str) -> str:
    return on_edges("SELECT event_id, hit_id, arg_min(alpha_id, sid) AS centre_id, min(sid)::BIGINT AS place FROM cover JOIN alphas USING (event_id, pt) GROUP BY 1, 2", LOCAL.format(cond=cond), LOCAL_ALPHAS)


@query(centres_sql("TRUE"))
def local_cluster(t: Tables) -> DataFrame:
    """Rows in descending score; a free row becomes a centre and takes its free neighbours. place: the centre's number."""
    return gr.local_cluster(kn.knn(t.hits(), K), t.hits(), "beta").select(*KEY, "centre_id", "place")


@query(centres_sql("a.beta >= 0.4"))
def local_cluster_gated(t: Tables) -> DataFrame:
    """Rows below a score are centres of themselves only."""
    return gr.local_cluster(kn.knn(t.hits(), K), t.hits(), "beta", least=0.4).select(*KEY, "centre_id", "place")


@query(centres_sql("a.beta >= 0.4").replace("SELECT event_id, hit_id, arg_min(alpha_id, sid) AS centre_id, min(sid)::BIGINT AS place FROM cover JOIN alphas USING (event_id, pt) GROUP BY 1, 2", "SELECT event_id, count(*) AS n, max(sid)::BIGINT + 1 AS places FROM alphas GROUP BY 1"))
def local_cluster_splits(t: Tables) -> DataFrame:
    """How many centres each event selects."""
    rows = gr.local_cluster(kn.knn(t.hits(), K), t.hits(), "beta", least=0.4)
    return rows.where("hit_id = centre_id").groupBy("event_id").agg(F.count("*").alias("n"), (F.max("place") + 1).cast("long").alias("places"))


# In the first pass a centre also covers the neighbours of what it takes; the second pass is over what the first one leaves.
GROUP = ["""cand AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY beta DESC, hit_id) AS rk FROM hits),
  takes AS (SELECT e.event_id, e.hit_id AS centre_id, e.nbr_id AS hit_id, e.slot, a.rk AS pt, b.rk AS other FROM edges e JOIN cand a ON a.event_id = e.event_id AND a.hit_id = e.hit_id JOIN cand b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id WHERE e.slot = 0 OR a.beta >= 0.4),
  cover AS (SELECT DISTINCT t.event_id, t.pt, b.rk AS other FROM takes t JOIN edges e ON e.event_id = t.event_id AND e.hit_id = t.hit_id JOIN cand b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id)""",
  LOCAL_ALPHAS,
  """got AS (SELECT event_id, hit_id, arg_min(centre_id, pt) AS centre_id, min(pt) AS pt, arg_min(slot, pt) AS slot FROM takes JOIN alphas USING (event_id, pt) GROUP BY 1, 2),
  rest AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM got g WHERE g.event_id = c.event_id AND g.hit_id = c.hit_id)),
  takes2 AS (SELECT t.* FROM takes t JOIN rest a ON a.event_id = t.event_id AND a.rk = t.pt JOIN rest b ON b.event_id = t.event_id AND b.rk = t.other)""",
  LOCAL_ALPHAS.replace("alphas AS", "alphas2 AS").replace("FROM cover ", "FROM takes2 ").replace("FROM cand k", "FROM rest k").replace("FROM hits GROUP BY", "FROM rest GROUP BY"),
  """got2 AS (SELECT event_id, hit_id, arg_min(centre_id, pt) AS centre_id, min(pt) AS pt, arg_min(slot, pt) AS slot FROM takes2 JOIN alphas2 USING (event_id, pt) GROUP BY 1, 2)"""]


@query(on_edges("""SELECT event_id, hit_id, centre_id, dense_rank() OVER (PARTITION BY event_id ORDER BY p, pt) - 1 AS place, row_number() OVER (PARTITION BY event_id, centre_id ORDER BY slot) - 1 AS slot
  FROM (SELECT *, 0 AS p FROM got UNION ALL SELECT *, 1 FROM got2)""", *GROUP))
def local_group(t: Tables) -> DataFrame:
    """Grouping in two passes: the first one leaves rows alone that are neighbours of what was taken before."""
    return gr.local_group(kn.knn(t.hits(), K), t.hits(), "beta", 0.4)


# The best assignment as a table: predicted objects one after another, the best total for each set of true objects used.
ASSIGNED_PAIRS = """pnum AS (SELECT event_id, pred, row_number() OVER (PARTITION BY event_id ORDER BY pred) AS pn FROM (SELECT DISTINCT event_id, pred FROM ious WHERE iou >= 0.1)),
  opts AS (SELECT event_id, pn, i.t_idx, i.pred, i.iou FROM ious i JOIN pnum USING (event_id, pred) WHERE iou >= 0.1 UNION ALL SELECT event_id, pn, -1, pred, 0.0 FROM pnum),
  dp AS (WITH RECURSIVE best(event_id, pn, mask, total, pairs) AS (
    SELECT DISTINCT event_id, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, CAST([] AS BIGINT[]) FROM pnum
    UNION ALL SELECT event_id, pn, mask, total, pairs FROM (SELECT b.event_id, o.pn, CASE WHEN o.t_idx < 0 THEN b.mask ELSE b.mask + (1::BIGINT << o.t_idx) END AS mask, b.total + o.iou AS total,
      CASE WHEN o.t_idx < 0 THEN b.pairs ELSE list_append(b.pairs, o.pred * 1000 + o.t_idx) END AS pairs FROM best b JOIN opts o ON o.event_id = b.event_id AND o.pn = b.pn + 1 WHERE o.t_idx < 0 OR (b.mask >> o.t_idx) % 2 = 0)
      QUALIFY row_number() OVER (PARTITION BY event_id, pn, mask ORDER BY total DESC) = 1)
    SELECT event_id, unnest(pairs) AS pair FROM (SELECT event_id, arg_max(pairs, total) AS pairs FROM best JOIN (SELECT event_id, max(pn) AS pn FROM pnum GROUP BY 1) USING (event_id, pn) GROUP BY 1)),
  matches AS (SELECT d.event_id, CAST(d.pair % 1000 AS INTEGER) AS t_idx, CAST(d.pair // 1000 AS INTEGER) AS pred, i.iou FROM dp d JOIN ious i ON i.event_id = d.event_id AND i.t_idx = d.pair % 1000 AND i.pred = d.pair // 1000)"""
TRUTH = "truth AS (SELECT event_id, t_idx, sum(energy) AS t_energy FROM hits WHERE t_idx >= 0 GROUP BY 1, 2)"


@query(on_hits("SELECT event_id, t_idx, pred, round(iou, 6) AS iou FROM matches", IOU, ASSIGNED_PAIRS))
def match_objects(t: Tables) -> DataFrame:
    """The assignment with the greatest total overlap."""
    m = ma.match(ma.overlap(predicted(t), "t_idx", "pred", "energy"), "t_idx", "pred", 0.1)
    return m.select("event_id", "t_idx", "pred", r("iou").alias("iou"))


FRAME = """preds AS (SELECT event_id, pred, sum(energy) AS pred_energy FROM phits GROUP BY 1, 2),
  frame AS (SELECT coalesce(l.event_id, p.event_id) AS event_id, l.t_idx, coalesce(l.pred, p.pred) AS pred, l.t_energy, p.pred_energy, l.iou FROM (SELECT t.event_id, t.t_idx, m.pred, t.t_energy, m.iou FROM truth t LEFT JOIN matches m USING (event_id, t_idx)) l
  FULL JOIN preds p ON p.event_id = l.event_id AND p.pred = l.pred)"""


@query(on_hits("SELECT event_id, t_idx, pred, round(t_energy, 5) AS t_energy, round(pred_energy, 5) AS pred_energy, round(iou, 6) AS iou FROM frame", IOU, ASSIGNED_PAIRS, TRUTH, "phits AS (SELECT *, CAST(floor(x/17) AS INTEGER) AS pred FROM hits)", FRAME))
def matched_objects(t: Tables) -> DataFrame:
    """True and predicted objects, matched or alone: a full outer join through the matches."""
    return ma.frame(predicted(t), "energy", 0.1).select("event_id", "t_idx", "pred", r("t_energy", 5).alias("t_energy"), r("pred_energy", 5).alias("pred_energy"), r("iou").alias("iou"))


EDGES = [0, 50, 100, 150, 200, 300, 400, 600, 1000, 2000]
FOUND = """phits AS (SELECT h.*, CAST(a.sid AS INTEGER) AS pred FROM hits h JOIN assigned a USING (event_id, hit_id) WHERE a.sid >= 0),
  ious AS (SELECT i.event_id, i.t_idx, i.pred, i.w/(t.w+p.w-i.w) AS iou FROM (SELECT event_id, t_idx, pred, sum(energy) AS w FROM phits WHERE t_idx >= 0 GROUP BY 1, 2, 3) i
  JOIN (SELECT event_id, t_idx, sum(energy) AS w FROM hits WHERE t_idx >= 0 GROUP BY 1, 2) t USING (event_id, t_idx) JOIN (SELECT event_id, pred, sum(energy) AS w FROM phits GROUP BY 1, 2) p USING (event_id, pred))"""
N_TRUE, N_PRED = "count(t_energy)", "count(pred_energy)"


@query(on_assigned(f"""SELECT bin, {N_TRUE} AS n_true, {N_PRED} AS n_pred, round(count(CASE WHEN t_energy IS NOT NULL AND pred_energy IS NOT NULL THEN 1 END)*1.0/nullif({N_TRUE}, 0), 6) AS efficiency,
  round(count(CASE WHEN t_energy IS NULL THEN 1 END)*1.0/nullif({N_PRED}, 0), 6) AS fake_rate, round(avg(pred_energy/t_energy), 5) AS response, round(stddev_pop(pred_energy/t_energy), 5) AS spread
  FROM (SELECT *, {cases('coalesce(t_energy, pred_energy)', EDGES, False)} AS bin FROM frame) WHERE bin IS NOT NULL GROUP BY 1""", FOUND, ASSIGNED_PAIRS, TRUTH, FRAME))
def analyse(t: Tables) -> DataFrame:
    """The flagship: cluster hits, match objects, join both sides in full, and give binned efficiency, response and fakes."""
    rows = condensed_hits(t)
    frame = ma.frame(rows, "energy", 0.1)
    is_t, is_p = F.col("t_energy").isNotNull(), F.col("pred_energy").isNotNull()
    b = bin_of(F.coalesce("t_energy", "pred_energy"), EDGES, False)
    n = frame.groupBy(b.alias("bin")).agg(
        F.count_if(is_t).alias("n_true"), F.count_if(is_p).alias("n_pred"), r(F.try_divide(F.count_if(is_t & is_p), F.count_if(is_t)), 6).alias("efficiency"),
        r(F.try_divide(F.count_if(is_p & ~is_t), F.count_if(is_p)), 6).alias("fake_rate"), r(F.avg(F.col("pred_energy") / F.col("t_energy")), 5).alias("response"),
        r(F.stddev_pop(F.col("pred_energy") / F.col("t_energy")), 5).alias("spread"),
    )
    return n.where("bin is not null")


def condensed_hits(t: Tables) -> DataFrame:
    """Hits with the object (pred; -1: noise) that the clustering gives them, in one pass over events."""
    return co.condense(t.hits(), "beta", 10 + 5 * c.beta, 0.3, keep=("t_idx", "energy")).withColumnRenamed("sid", "pred")
