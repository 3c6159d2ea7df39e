"""Queries of further selections, gathers with defaults, layouts and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.functions.columns import c
from hitloom.operators import condense as co
from hitloom.operators import select as sel
from hitloom.plans.registry import on_hits, query, r
from hitloom.session import shared_dir
from hitloom.sources.store import MetricsStore
from hitloom.sources.tables import Tables

KEY = ["event_id", "hit_id"]

# Particle codes by class of the old scheme. All others are class 3 and not known.
OLD_CLASSES = {0: (11, -11, 22), 1: (211, -211, 321, -321, 2212, -2212), 2: (13, -13), 3: (111, -111, 130, -130, 310, -310, 2112, -2112, 3122, -3122)}
CODES = [22, -11, 211, -321, 13, 111, 2212, -3122, 999, 130, 12]


def coded_sql() -> str:
    return f"CAST(list_extract([{', '.join(map(str, CODES))}], CAST(l_suppkey % {len(CODES)} AS INTEGER) + 1) AS INTEGER)"


@query(f"""SELECT l_orderkey, l_linenumber, CASE {' '.join(f"WHEN code IN {codes} THEN {k}" for k, codes in OLD_CLASSES.items())} ELSE 3 END AS class,
  CASE WHEN code IN {tuple(x for codes in OLD_CLASSES.values() for x in codes)} THEN 1 ELSE 0 END AS known FROM (SELECT *, {coded_sql()} AS code FROM lineitem)""")
def old_classes(t: Tables) -> DataFrame:
    """Four classes of particle codes, and whether the code is known."""
    code = F.get(F.array(*map(F.lit, CODES)), (F.col("l_suppkey") % len(CODES)).cast("int"))
    number = F.lit(None).cast("int")
    for k, codes in OLD_CLASSES.items():
        number = F.when(code.isin(*codes), k).otherwise(number)
    rows = t.table("lineitem").select("l_orderkey", "l_linenumber", number.alias("n"))
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("n", F.lit(3)).alias("class"), F.col("n").isNotNull().cast("int").alias("known"))


CONDITIONS = {"pos": ">0", "nonneg": ">=0", "neg": "<0", "nonpos": "<=0", "zero": "==0", "nonzero": "!=0"}


@query(on_hits("SELECT event_id, hit_id, " + ", ".join(f"round(CASE WHEN t_idx {op} THEN -1 ELSE energy END, 6) AS {name}" for name, op in CONDITIONS.items()) + " FROM hits"))
def where_conditions(t: Tables) -> DataFrame:
    """A constant where a column meets a condition against 0, the value elsewhere."""
    return t.hits().select(*KEY, *(r(F.when(F.expr(f"t_idx {op}"), -1.0).otherwise(c.energy)).alias(name) for name, op in CONDITIONS.items()))


@query(on_hits("SELECT event_id, hit_id FROM hits WHERE beta > 0.9"))
def select_strict(t: Tables) -> DataFrame:
    """Scores above a threshold; an event may lose all its rows."""
    return t.hits().where("beta > 0.9").select(*KEY)


BEST = "best AS (SELECT event_id, t_idx, arg_max(hit_id, beta*1000000 - hit_id/1000.0) AS alpha FROM hits WHERE t_idx >= 0 GROUP BY 1, 2)"


def objects_best(t: Tables) -> DataFrame:
    """Each object's row with the highest beta (the first of equals)."""
    return t.hits().where("t_idx >= 0").groupBy("event_id", "t_idx").agg(F.max_by("hit_id", c.beta * 1000000 - F.col("hit_id") / 1000.0).alias("alpha"))


@query(on_hits("SELECT event_id, hit_id, CASE WHEN beta < 0.2 OR alpha IS NULL THEN hit_id ELSE alpha END AS alpha_id, CASE WHEN beta < 0.2 THEN -1 ELSE t_idx END AS sid FROM hits LEFT JOIN best USING (event_id, t_idx)", BEST))
def clean_condensations(t: Tables) -> DataFrame:
    """Rows of low score leave their object and stand for themselves."""
    low = c.beta < 0.2
    rows = t.hits().join(objects_best(t), ["event_id", "t_idx"], "left")
    return rows.select(*KEY, F.when(low | F.col("alpha").isNull(), F.col("hit_id")).otherwise(F.col("alpha")).alias("alpha_id"), F.when(low, -1).otherwise(F.col("t_idx")).alias("sid"))


@query(on_hits("SELECT event_id, hit_id FROM hits QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY md5('42-' || event_id || '-' || hit_id), hit_id) <= 8"))
def downsample(t: Tables) -> DataFrame:
    """At most eight rows of each event, chosen by a seeded hash."""
    return sel.downsample(t.hits(), 8, seed=42).select(*KEY)


@query("SELECT l_partkey AS event_id, row_number() OVER (ORDER BY md5('42-' || l_partkey), l_partkey) - 1 AS place FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def shuffle_events(t: Tables) -> DataFrame:
    """Events in a seeded random order: the same places in every run."""
    return sel.shuffled(t.table("lineitem").select(F.col("l_partkey").alias("event_id")).distinct(), seed=42)


@query(on_hits("SELECT l.event_id, t_idx, pred, round(e, 5) AS energy FROM (SELECT event_id, t_idx, sum(energy) AS e FROM hits GROUP BY 1, 2) l FULL JOIN (SELECT event_id, CAST(floor(x/9) AS INTEGER) AS pred FROM hits GROUP BY 1, 2) p ON p.event_id = l.event_id AND p.pred = l.t_idx WHERE t_idx < 4"))
def pile_up_removed(t: Tables) -> DataFrame:
    """A matched frame without true objects from a mark on; predictions without truth go with them, as a null meets no condition, and true objects without a prediction stay."""
    truth = t.hits().groupBy("event_id", "t_idx").agg(F.sum("energy").alias("e"))
    pred = t.hits().select("event_id", F.floor(c.x / 9).cast("int").alias("pred")).distinct()
    frame = truth.join(pred, (truth["event_id"] == pred["event_id"]) & (F.col("t_idx") == F.col("pred")), "full_outer").select(truth["event_id"], "t_idx", "pred", "e")
    return sel.without_pile_up(frame, 4).select("event_id", "t_idx", "pred", r("e", 5).alias("energy"))


@query(on_hits("SELECT h.event_id, h.hit_id, round(coalesce(o.e, 0), 5) AS object_energy, coalesce(o.n, 0) AS object_size FROM hits h LEFT JOIN (SELECT event_id, t_idx, sum(energy) AS e, count(*) AS n FROM hits GROUP BY 1, 2) o ON o.event_id = h.event_id AND o.t_idx = h.t_idx AND h.t_idx >= 0"))
def object_attributes(t: Tables) -> DataFrame:
    """Attributes of each row's object by its index; a negative index takes null values' stand-ins."""
    o = t.hits().where("t_idx >= 0").groupBy("event_id", "t_idx").agg(F.sum("energy").alias("e"), F.count("*").alias("n"))
    rows = t.hits().join(o, ["event_id", "t_idx"], "left")
    return rows.select(*KEY, r(F.coalesce("e", F.lit(0.0)), 5).alias("object_energy"), F.coalesce("n", F.lit(0)).alias("object_size"))


def map_sql(name: str, of: str, thr: float) -> str:
    """A noise filter of rows `of` as a map from their hit_id to that of a kept row."""
    return f"""{name} AS (SELECT event_id, hit_id, CASE WHEN beta > {thr} OR beta = lo THEN hit_id ELSE first END AS new_id, beta FROM (SELECT *, min(CASE WHEN beta = lo THEN hit_id END) OVER (PARTITION BY event_id) AS first
  FROM (SELECT *, min(beta) OVER (PARTITION BY event_id) AS lo FROM {of})))"""


@query(on_hits("SELECT a.event_id, a.hit_id, b.new_id AS top_id, round(h.energy, 5) AS energy FROM a JOIN b ON b.event_id = a.event_id AND b.hit_id = a.new_id JOIN hits h ON h.event_id = a.event_id AND h.hit_id = b.new_id",
  map_sql("a", "hits", 0.4), "kept AS (SELECT h.* FROM hits h JOIN a ON a.event_id = h.event_id AND a.hit_id = h.hit_id AND a.new_id = a.hit_id)", map_sql("b", "kept", 0.8)))
def back_gather_levels(t: Tables) -> DataFrame:
    """Values of the last level on all rows of the first, through a chain of maps."""
    first, a = sel.noise_filter(t.hits(), "beta", 0.4)
    second, b = sel.noise_filter(first, "beta", 0.8)
    return sel.back_gather(sel.chained(a, b), second, "energy").select(*KEY, F.col("new_id").alias("top_id"), r("energy", 5).alias("energy"))


@query(on_hits("SELECT DISTINCT a.event_id, a.hit_id, CASE WHEN b.hit_id IS NOT NULL AND b.new_id <> b.hit_id THEN 2 WHEN a.new_id <> a.hit_id THEN 1 ELSE 0 END AS removed_at FROM a LEFT JOIN b ON b.event_id = a.event_id AND b.hit_id = a.hit_id",
  map_sql("a", "hits", 0.4), "kept AS (SELECT h.* FROM hits h JOIN a ON a.event_id = h.event_id AND a.hit_id = h.hit_id AND a.new_id = a.hit_id)", map_sql("b", "kept", 0.8)))
def scatter_chain(t: Tables) -> DataFrame:
    """The stage of a chain of filters that takes each row away (0: none does)."""
    first, a = sel.noise_filter(t.hits(), "beta", 0.4)
    second, _ = sel.noise_filter(first, "beta", 0.8)
    stages = sel.removed_at(t.hits(), [first, second])
    return stages.select(*KEY, "removed_at")


# What rows that no filter kept get in each column of a prediction.
DEFAULTS = {"cx": 100.0, "cy": 100.0, "beta": 0.0, "corr": 1.0, "q_low": 1.0, "q_high": 1.0, "pos": 0.0, "time": 10.0, "pid": 0.0, "dist": 1.0, "pfc_idx": -1.0}
PREDICTED = {"cx": "x", "cy": "y", "beta": "beta", "corr": "energy/50", "q_low": "tax", "q_high": "tax+1", "pos": "z", "time": "x-y", "pid": "t_idx", "dist": "beta+0.5", "pfc_idx": "hit_id"}


@query(on_hits("SELECT event_id, hit_id, " + ", ".join(f"round(CASE WHEN beta > 0.6 THEN {PREDICTED[k]} ELSE {d} END, 5) AS {k}" for k, d in DEFAULTS.items()) + " FROM hits"))
def reintegrate(t: Tables) -> DataFrame:
    """Predictions of the kept rows among all rows, each column with its own default."""
    kept = t.hits().where("beta > 0.6").select(*KEY, *(F.expr(PREDICTED[k]).cast("double").alias(k) for k in DEFAULTS))
    return sel.back_scatter(t.hits(), kept, DEFAULTS).select(*KEY, *(r(k, 5).alias(k) for k in DEFAULTS))


@query(on_hits("SELECT h.event_id, h.hit_id, coalesce(d.dense, -1) AS label FROM hits h LEFT JOIN (SELECT event_id, t_idx, row_number() OVER (PARTITION BY event_id ORDER BY min(hit_id)) - 1 AS dense FROM hits WHERE t_idx >= 0 AND (beta > 0.5 OR is_track) GROUP BY 1, 2) d ON d.event_id = h.event_id AND d.t_idx = h.t_idx AND (h.beta > 0.5 OR h.is_track)"))
def noise_stage(t: Tables) -> DataFrame:
    """Rows pass by their score, tracks always; labels of what passes are numbered anew and put back among all rows."""
    kept = t.hits().withColumn("score", F.when(F.col("is_track"), 1.0).otherwise(c.beta)).where("score > 0.5")
    dense = co.normalised_labels(kept, "t_idx").select(*KEY, F.col("dense").cast("long").alias("dense"))
    return t.hits().select(*KEY).join(dense, KEY, "left").select(*KEY, F.coalesce("dense", F.lit(-1).cast("long")).alias("label"))


@query(on_hits("""SELECT event_id, hit_id, round(thr, 6) AS threshold, round(energy/(1+exp(-20*(beta - 0.23 - thr))), 5) AS weighted FROM (SELECT *, least(0.9, max(beta) OVER (PARTITION BY event_id), (SELECT min(m) - 1e-2 FROM (SELECT max(beta) AS m FROM hits GROUP BY event_id))) AS thr FROM hits) WHERE beta >= thr"""))
def select_ragged(t: Tables) -> DataFrame:
    """Each event's threshold is lowered to its best score, then to just below the least best score of all events."""
    return sel.select_lowered_twice(t.hits(), "beta", 0.9).select(*KEY, r("thr").alias("threshold"), r(c.energy * F.col("weight"), 5).alias("weighted"))


@query(on_hits("SELECT hit_id, round(energy, 5) AS energy, round(ln(energy + 1 + 1e-8), 6) AS log_energy FROM hits WHERE event_id = 7"))
def single_event(t: Tables) -> DataFrame:
    """One event's rows, by a filter that the scan takes."""
    return t.hits().where("event_id = 7").select("hit_id", r("energy", 5).alias("energy"), r(F.log(c.energy + 1 + 1e-8)).alias("log_energy"))


@query(on_hits("SELECT event_id, count(*) AS n FROM hits WHERE event_id IN (SELECT DISTINCT event_id FROM hits ORDER BY event_id LIMIT 10) GROUP BY 1"))
def first_events(t: Tables) -> DataFrame:
    """The first ten events by id."""
    ids = t.table("lineitem").select(F.col("l_partkey").alias("event_id")).distinct().orderBy("event_id").limit(10)
    return t.hits().join(F.broadcast(ids), "event_id", "left_semi").groupBy("event_id").agg(F.count("*").alias("n"))


@query(on_hits("SELECT event_id, hit_id, round(energy, 5) AS energy, x, round(y, 5) AS y, round(z, 5) AS z, 0.0::DOUBLE AS time, first_value(t_idx) OVER (PARTITION BY event_id, x ORDER BY energy DESC, hit_id) AS top_particle FROM hits"))
def layout_cells(t: Tables) -> DataFrame:
    """Another detector's columns: position and energy, no times, and the particle of most energy in the cell."""
    w = Window.partitionBy("event_id", "x").orderBy(F.desc("energy"), "hit_id")
    return t.hits().select(*KEY, r("energy", 5).alias("energy"), "x", r("y", 5).alias("y"), r("z", 5).alias("z"), F.lit(0.0).alias("time"), F.first("t_idx").over(w).alias("top_particle"))


@query(on_hits("SELECT event_id, hit_id, round(energy/1000, 7) AS energy, 0.0::DOUBLE AS eta, CASE WHEN t_idx > 0 THEN 0 ELSE -1 END AS t_idx, round(CASE WHEN t_idx > 0 THEN energy/1000 ELSE 0 END, 7) AS signal_energy FROM hits"))
def layout_signal(t: Tables) -> DataFrame:
    """A layout with a signal flag instead of objects; what it lacks is 0."""
    signal = F.col("t_idx") > 0
    return t.hits().select(*KEY, r(c.energy / 1000, 7).alias("energy"), F.lit(0.0).alias("eta"), F.when(signal, 0).otherwise(-1).alias("t_idx"), r(F.when(signal, c.energy / 1000).otherwise(0.0), 7).alias("signal_energy"))


@query(on_hits("SELECT event_id, count(*) AS n, round(sum(beta), 5) AS beta, sum(CASE WHEN t_idx >= 0 THEN 1 ELSE 0 END)::BIGINT AS true_hits FROM hits GROUP BY 1"))
def prediction_sink(t: Tables) -> DataFrame:
    """Features, truth and predictions of events in one table that is written and scanned again."""
    path = f"{shared_dir(t.spark)}/predictions-{uuid.uuid4().hex}"
    t.hits().select(*KEY, F.struct("x", "y", "z", "energy").alias("features"), F.struct("t_idx").alias("truth"), F.struct("beta").alias("prediction")).write.parquet(path)
    rows = t.spark.read.parquet(path)
    return rows.groupBy("event_id").agg(F.count("*").alias("n"), r(F.sum("prediction.beta"), 5).alias("beta"), F.count_if(F.col("truth.t_idx") >= 0).alias("true_hits"))


@query(on_hits("""SELECT 'events' AS part, count(*) AS n, round(sum(e), 3) AS total FROM (SELECT event_id, sum(energy) AS e FROM hits GROUP BY 1) UNION ALL
  SELECT 'objects', count(*), round(sum(e), 3) FROM (SELECT event_id, t_idx, sum(energy) AS e FROM hits WHERE t_idx >= 0 GROUP BY 1, 2) UNION ALL SELECT 'settings', 1, round(0.3+1.0, 3)"""))
def analysis_dump(t: Tables) -> DataFrame:
    """Tables of an analysis and a row of its settings under one folder, scanned again."""
    path = f"{shared_dir(t.spark)}/analysis-{uuid.uuid4().hex}"
    t.hits().groupBy("event_id").agg(F.sum("energy").alias("energy")).write.parquet(f"{path}/events")
    t.hits().where("t_idx >= 0").groupBy("event_id", "t_idx").agg(F.sum("energy").alias("energy")).write.parquet(f"{path}/objects")
    t.spark.createDataFrame([(0.3, 1.0)], "beta_threshold double, distance_threshold double").write.parquet(f"{path}/settings")

    def told(part: str) -> DataFrame:
        return t.spark.read.parquet(f"{path}/{part}").agg(F.count("*").alias("n"), r(F.sum("energy"), 3).alias("total")).select(F.lit(part).alias("part"), "n", "total")

    settings = t.spark.read.parquet(f"{path}/settings").select(F.lit("settings").alias("part"), F.lit(1).cast("long").alias("n"), r(F.col("beta_threshold") + F.col("distance_threshold"), 3).alias("total"))
    return told("events").unionByName(told("objects")).unionByName(settings)


@query("SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events WHERE value > 5 GROUP BY 1")
def store_query(t: Tables) -> DataFrame:
    """SQL on a table of the metrics store."""
    store = MetricsStore(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")
    store.insert("values", t.table("events").select(F.col("event_type").alias("experiment_name"), "event_id", "value"))
    return store.query("SELECT experiment_name AS event_type, count(*) AS n, max(event_id) AS last_id FROM {values} WHERE value > 5 GROUP BY 1", values="values")


@query("""SELECT e.event_type, count(*) AS n, min(e.event_id) AS first_id, max(e.event_id) AS last_id FROM events e LEFT JOIN (SELECT event_type, max(event_id) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-11 00:00:00' AND event_type <> 'error' GROUP BY 1) m
  ON m.event_type = e.event_type WHERE m.mark IS NULL OR e.event_id > m.mark GROUP BY 1""")
def fetch_since_marks(t: Tables) -> DataFrame:
    """Rows past what a cache already holds, each experiment by the greatest id that the cache has of it."""
    events = t.table("events")
    cache = events.where(F.col("ts") < F.lit("2024-01-11 00:00:00").cast("timestamp")).where("event_type <> 'error'")
    return sel.past_marks(events, cache, "event_type", "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(on_hits("SELECT event_id, t_idx, row_number() OVER (PARTITION BY event_id ORDER BY md5('7-' || event_id || '-' || t_idx), t_idx) - 1 AS colour FROM (SELECT DISTINCT event_id, t_idx FROM hits WHERE t_idx >= 0)"))
def permuted_labels(t: Tables) -> DataFrame:
    """Labels of each event in a seeded random order, for colours."""
    labels = t.hits().where("t_idx >= 0").select("event_id", "t_idx").distinct()
    w = Window.partitionBy("event_id").orderBy(sel.seeded(7, "event_id", "t_idx"), "t_idx")
    return labels.select("event_id", "t_idx", (F.row_number().over(w) - 1).cast("long").alias("colour"))
