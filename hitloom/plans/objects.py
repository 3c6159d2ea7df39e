"""Queries of objects in events: labels, collections, clustering and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hitloom.functions.columns import c
from hitloom.operators import condense as co
from hitloom.operators import matching as ma
from hitloom.operators import scans as sc
from hitloom.operators import select as sel
from hitloom.plans.registry import on_hits, query, r
from hitloom.sources.tables import Tables

KEY = ["event_id", "hit_id"]
#: Rows of a page of a list.
PAGE = 4


def event() -> WindowSpec:
    return Window.partitionBy("event_id")


@query(on_hits("SELECT event_id, t_idx, min(hit_id) AS first_id, count(*) AS n FROM hits GROUP BY 1, 2"))
def unique_indices(t: Tables) -> DataFrame:
    return t.hits().groupBy("event_id", "t_idx").agg(F.min("hit_id").alias("first_id"), F.count("*").alias("n"))


@query(on_hits("SELECT event_id, hit_id, CAST(CASE WHEN row_number() OVER (PARTITION BY event_id, t_idx ORDER BY hit_id) = 1 THEN 1 ELSE 0 END AS INTEGER) AS is_unique FROM hits"))
def is_unique_flag(t: Tables) -> DataFrame:
    w = Window.partitionBy("event_id", "t_idx").orderBy("hit_id")
    return t.hits().select(*KEY, (F.row_number().over(w) == 1).cast("int").alias("is_unique"))


@query(on_hits(f"SELECT event_id, t_idx, page, array_to_string(list(hit_id ORDER BY hit_id), ',') AS members, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY event_id, t_idx ORDER BY hit_id) - 1) // {PAGE} AS page FROM hits WHERE t_idx >= 0) GROUP BY 1, 2, 3"))
def object_members(t: Tables) -> DataFrame:
    """The rows of each object, in pages of fixed length."""
    m = sel.paged(t.hits().where("t_idx >= 0"), ["event_id", "t_idx"], "hit_id", PAGE, "m")
    return m.select("event_id", "t_idx", "page", F.array_join("m", ",").alias("members"), "n")


@query(on_hits("SELECT o.event_id, o.t_idx, count(*) AS others FROM (SELECT DISTINCT event_id, t_idx FROM hits WHERE t_idx >= 0) o JOIN hits h ON h.event_id = o.event_id AND h.t_idx <> o.t_idx GROUP BY 1, 2"))
def object_complement(t: Tables) -> DataFrame:
    """Rows of the event outside each object, without pairing them: event size less object size."""
    n = t.hits().groupBy("event_id", "t_idx").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(event()))
    return n.where("t_idx >= 0 and all > n").select("event_id", "t_idx", (F.col("all") - F.col("n")).alias("others"))


@query(on_hits("SELECT h.event_id, h.hit_id, CASE WHEN h.t_idx < 0 THEN -1 ELSE d.dense END AS dense FROM hits h LEFT JOIN (SELECT event_id, t_idx, row_number() OVER (PARTITION BY event_id ORDER BY min(hit_id)) - 1 AS dense FROM hits WHERE t_idx >= 0 GROUP BY 1, 2) d ON d.event_id = h.event_id AND d.t_idx = h.t_idx"))
def normalise_labels(t: Tables) -> DataFrame:
    return co.normalised_labels(t.hits(), "t_idx").select(*KEY, F.col("dense").cast("long").alias("dense"))


@query(on_hits("SELECT event_id, t_idx, off + t_idx AS global_id FROM (SELECT DISTINCT event_id, t_idx FROM hits WHERE t_idx >= 0) JOIN (SELECT event_id, coalesce(sum(m) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM (SELECT event_id, max(t_idx) + 1 AS m FROM hits GROUP BY 1)) USING (event_id)"))
def segment_ids(t: Tables) -> DataFrame:
    """Ids that are unique over all events: running sums of the events' id counts.

    Sums over ranges of events come first, so that no task orders more than one range.
    """
    rows = t.hits().groupBy("event_id").agg((F.max("t_idx") + 1).cast("long").alias("m")).withColumn("all", F.lit(0))
    rows = sc.running_sum(sc.numbered(rows, "event_id", [], "at", by=("all",)), "at", "m", "run", by=("all",))
    off = rows.select("event_id", (F.col("run") - F.col("m")).alias("off"))
    return t.hits().where("t_idx >= 0").select("event_id", "t_idx").distinct().join(off, "event_id").select("event_id", "t_idx", (F.col("off") + F.col("t_idx")).cast("long").alias("global_id"))


@query(on_hits("SELECT event_id, hit_id, round(CASE WHEN t_idx >= 0 THEN sum(energy) OVER (PARTITION BY event_id, t_idx) ELSE 0 END, 5) AS object_energy FROM hits"))
def object_energy(t: Tables) -> DataFrame:
    rows = co.object_energy(t.hits().select(*KEY, F.col("t_idx").alias("sid")), t.hits())
    return rows.select(*KEY, r("object_energy", 5).alias("object_energy"))


@query(on_hits("SELECT event_id, t_idx, round(avg(x), 5) AS mean, round(max(x), 5) AS max, round(sum(x), 5) AS total FROM hits WHERE t_idx >= 0 GROUP BY 1, 2"))
def ragged_collapse(t: Tables) -> DataFrame:
    return t.hits().where("t_idx >= 0").groupBy("event_id", "t_idx").agg(r(F.avg("x"), 5).alias("mean"), r(F.max("x"), 5).alias("max"), r(F.sum("x"), 5).alias("total"))


@query(on_hits("SELECT event_id, hit_id, round(avg(x) OVER w, 5) AS mean, round(min(x) OVER w, 5) AS lo, round(max(x) OVER w, 5) AS hi FROM hits WINDOW w AS (PARTITION BY event_id)"))
def global_exchange(t: Tables) -> DataFrame:
    return t.hits().select(*KEY, r(F.avg("x").over(event()), 5).alias("mean"), r(F.min("x").over(event()), 5).alias("lo"), r(F.max("x").over(event()), 5).alias("hi"))


@query(on_hits("SELECT event_id, hit_id, round(x - avg(x) OVER (PARTITION BY event_id, t_idx), 5) AS dx, round(energy / sum(energy) OVER (PARTITION BY event_id, t_idx), 6) AS share FROM hits WHERE t_idx >= 0"))
def mix_hit_object(t: Tables) -> DataFrame:
    w = Window.partitionBy("event_id", "t_idx")
    return t.hits().where("t_idx >= 0").select(*KEY, r(F.col("x") - F.avg("x").over(w), 5).alias("dx"), r(c.energy / F.sum("energy").over(w)).alias("share"))


@query(on_hits("SELECT event_id, t_idx, round(sum(CASE WHEN is_track THEN 0 ELSE energy*x END)/nullif(sum(CASE WHEN is_track THEN 0 ELSE energy END), 0), 5) AS x, round(max(energy), 5) AS top, arg_max(hit_id, beta*1000000 - hit_id/1000.0) AS alpha FROM hits WHERE t_idx >= 0 GROUP BY 1, 2"))
def object_truth(t: Tables) -> DataFrame:
    """Energy-weighted means without tracks, and each object's best row."""
    w = F.when(F.col("is_track"), 0.0).otherwise(c.energy)
    return t.hits().where("t_idx >= 0").groupBy("event_id", "t_idx").agg(
        r(F.try_divide(F.sum(w * F.col("x")), F.sum(w)), 5).alias("x"), r(F.max("energy"), 5).alias("top"), F.max_by("hit_id", F.col("beta") * 1000000 - F.col("hit_id") / 1000.0).alias("alpha")
    )


@query(on_hits("SELECT event_id, round(pow(sum(energy)-sum(CASE WHEN is_track THEN 0 ELSE energy END), 2)/pow(abs(sum(energy))+1e-6, 2), 6) AS balance, count(*) AS n, count(DISTINCT t_idx) AS n_objects, round(sum(CASE WHEN t_idx >= 0 THEN 1.0 ELSE 0 END)/count(*), 6) AS truth_share FROM hits GROUP BY 1"))
def event_balance(t: Tables) -> DataFrame:
    lost = F.sum("energy") - F.sum(F.when(F.col("is_track"), 0.0).otherwise(c.energy))
    total = F.abs(F.sum("energy")) + 1e-6
    return t.hits().groupBy("event_id").agg(
        r(lost * lost / (total * total)).alias("balance"), F.count("*").alias("n"), F.count_distinct("t_idx").alias("n_objects"),
        r(F.sum(F.when(F.col("t_idx") >= 0, 1.0).otherwise(0.0)) / F.count("*")).alias("truth_share"),
    )


@query(on_hits("SELECT event_id, hit_id, round(sum(energy) OVER (PARTITION BY event_id ORDER BY hit_id), 5) AS running, row_number() OVER (PARTITION BY event_id ORDER BY energy DESC, hit_id) AS rank, round(sum(x) OVER (PARTITION BY event_id ORDER BY hit_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)/5, 5) AS smooth, round(sum(x) OVER (PARTITION BY event_id ORDER BY hit_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 5) AS last4 FROM hits"))
def running_sums(t: Tables) -> DataFrame:
    """Sums that start anew in each event, ranks, zero-padded running means, sums of the last four; all by parts of events."""
    rows = sc.running_sum(t.hits().select(*KEY, "x", "energy"), "hit_id", "energy", "running")
    rows = sc.numbered(rows, "energy", ["hit_id"], "rank", descending=True)
    rows = sc.moving_sum(sc.moving_sum(rows, "hit_id", "x", 2, 2, "smooth"), "hit_id", "x", 3, 0, "last4")
    return rows.select(*KEY, r("running", 5).alias("running"), F.col("rank").cast("long").alias("rank"), r(F.col("smooth") / 5, 5).alias("smooth"), r("last4", 5).alias("last4"))


@query(on_hits("SELECT event_id, hit_id, round(w/sum(w) OVER (PARTITION BY event_id, t_idx), 6) AS weight FROM (SELECT *, pow(atanh(beta/1.01), 2)+0.1 AS w FROM hits WHERE t_idx >= 0)"))
def payload_weights(t: Tables) -> DataFrame:
    a = F.atanh(F.col("beta") / 1.01)
    rows = t.hits().where("t_idx >= 0").withColumn("w", a * a + 0.1)
    return rows.select(*KEY, r(F.col("w") / F.sum("w").over(Window.partitionBy("event_id", "t_idx"))).alias("weight"))


# The sequential greedy as a recursive table: one step takes the best free candidate of each event.
GREEDY = """cand AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY beta DESC, hit_id) AS rk FROM hits),
  pairs AS (SELECT a.event_id, a.rk AS pt, b.rk AS other, b.hit_id, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d, (10+5*a.beta)*(10+5*a.beta) AS r2, a.hit_id AS alpha_id FROM cand a JOIN cand b ON a.event_id = b.event_id WHERE a.beta > 0.3),
  cover AS (SELECT * FROM pairs WHERE d <= r2)"""


def condensed(t: Tables, max_beta: bool, keep_noise: bool = False) -> DataFrame:
    return co.condense(t.hits(), "beta", 10 + 5 * F.col("beta"), 0.3, max_beta=max_beta, keep_noise=keep_noise)


ALPHAS = """alphas AS (WITH RECURSIVE step(event_id, taken, points, pt) AS (
  SELECT event_id, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), 0::BIGINT FROM hits GROUP BY event_id
  UNION ALL SELECT s.event_id, list_distinct(list_concat(s.taken, c.others)), list_append(s.points, c.pt), c.pt FROM step s JOIN (SELECT event_id, pt, list(other) AS others FROM cover GROUP BY 1, 2) c ON c.event_id = s.event_id
  WHERE c.pt = (SELECT min(k.rk) FROM cand k WHERE k.event_id = s.event_id AND k.beta > 0.3 AND NOT list_contains(s.taken, k.rk)))
  SELECT event_id, unnest(points) AS pt, generate_subscripts(points, 1) - 1 AS sid FROM (SELECT event_id, arg_max(points, len(points)) AS points FROM step GROUP BY 1))"""


@query(on_hits("""SELECT h.event_id, h.hit_id, coalesce(f.sid, -1) AS sid, f.alpha_id FROM hits h LEFT JOIN (SELECT event_id, hit_id, CAST(arg_min(sid, sid) AS BIGINT) AS sid, arg_min(alpha_id, sid) AS alpha_id
  FROM cover JOIN alphas USING (event_id, pt) GROUP BY 1, 2) f USING (event_id, hit_id)""", GREEDY, ALPHAS))
def condense_max_beta(t: Tables) -> DataFrame:
    """Density peaks; the best point that reaches a row keeps it."""
    return condensed(t, True).withColumn("sid", F.col("sid").cast("long"))


IOU = """ious AS (SELECT i.event_id, i.t_idx, i.pred, i.w/(t.w+p.w-i.w) AS iou FROM (SELECT event_id, t_idx, CAST(floor(x/17) AS INTEGER) AS pred, sum(energy) AS w FROM hits WHERE t_idx >= 0 GROUP BY 1, 2, 3) i
  JOIN (SELECT event_id, t_idx, sum(energy) AS w FROM hits WHERE t_idx >= 0 GROUP BY 1, 2) t USING (event_id, t_idx)
  JOIN (SELECT event_id, CAST(floor(x/17) AS INTEGER) AS pred, sum(energy) AS w FROM hits GROUP BY 1, 2) p USING (event_id, pred))"""


def predicted(t: Tables) -> DataFrame:
    """A simple stand-in for predicted objects: slices of x."""
    return t.hits().withColumn("pred", F.floor(F.col("x") / 17).cast("int"))


@query(on_hits("SELECT event_id, t_idx, pred, round(iou, 6) AS iou FROM ious", IOU))
def iou_matrix(t: Tables) -> DataFrame:
    return ma.overlap(predicted(t), "t_idx", "pred", "energy").select("event_id", "t_idx", "pred", r("iou").alias("iou"))


@query(on_hits("""SELECT event_id, round(best, 5) AS best FROM (SELECT a.event_id, max(a.s) AS best FROM (SELECT x.event_id, coalesce(x.v, 0)+coalesce(y.v, 0)+coalesce(z.v, 0) AS s FROM
  (SELECT e.event_id, c.t_idx, i.v FROM (SELECT DISTINCT event_id FROM thr) e CROSS JOIN (SELECT unnest(range(0, 8)) AS t_idx) c LEFT JOIN thr i ON i.event_id = e.event_id AND i.t_idx = c.t_idx AND i.pred = 0) x
  JOIN (SELECT e.event_id, c.t_idx, i.v FROM (SELECT DISTINCT event_id FROM thr) e CROSS JOIN (SELECT unnest(range(0, 8)) AS t_idx) c LEFT JOIN thr i ON i.event_id = e.event_id AND i.t_idx = c.t_idx AND i.pred = 1) y ON x.event_id = y.event_id AND x.t_idx <> y.t_idx
  JOIN (SELECT e.event_id, c.t_idx, i.v FROM (SELECT DISTINCT event_id FROM thr) e CROSS JOIN (SELECT unnest(range(0, 8)) AS t_idx) c LEFT JOIN thr i ON i.event_id = e.event_id AND i.t_idx = c.t_idx AND i.pred = 2) z ON z.event_id = x.event_id AND z.t_idx <> x.t_idx AND z.t_idx <> y.t_idx) a GROUP BY 1) WHERE best > 0""",
  IOU, "thr AS (SELECT event_id, t_idx, pred, CASE WHEN iou >= 0.1 THEN iou ELSE 0 END AS v FROM ious)"))
def match_score(t: Tables) -> DataFrame:
    """Total overlap of the assignment: the same for all optimal ones."""
    return ma.match(ma.overlap(predicted(t), "t_idx", "pred", "energy"), "t_idx", "pred", 0.1).groupBy("event_id").agg(r(F.sum("iou"), 5).alias("best"))
