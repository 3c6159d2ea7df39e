"""Queries of condensation potentials, classifier losses, contamination and conservation, and of features brought to one scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.functions.columns import c
from hitloom.operators import edges as ed
from hitloom.operators import knn as kn
from hitloom.operators import rounds
from hitloom.operators import select as sel
from hitloom.operators.events import large_events
from hitloom.plans.graphs import NB, edges
from hitloom.plans.objects import predicted
from hitloom.plans.registry import K, on_edges, on_hits, query, r
from hitloom.session import stored
from hitloom.sources.tables import DSQ, Tables, edges_sql

KEY, OBJECT = ["event_id", "hit_id"], ["event_id", "t_idx"]
# Fixed values of the potentials: least charge, shares of the two widths, the scale of the attraction before condensation, and the well's.
Q_MIN, OWN, OTHER, ATT_SCALE, WELL = 0.1, 0.95, 0.05, 0.1, 0.5

CHARGES = f"""qq AS (SELECT *, pow(atanh(beta/1.01), 2)+{Q_MIN} AS q, 5+50*tax AS d FROM hits),
  al AS (SELECT event_id, t_idx, hit_id AS alpha_id, x AS ax, y AS ay, q AS aq, beta AS ab, d AS ad FROM (SELECT *, row_number() OVER (PARTITION BY event_id, t_idx ORDER BY q DESC, hit_id) AS rn FROM qq WHERE t_idx >= 0) WHERE rn = 1)"""
WIDTHS = f"((x-ax)*(x-ax)+(y-ay)*(y-ay))/({OWN}*ad*ad+{OTHER}*d*d+1e-4)"


def charges(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Hits with charge q and width d, and the row of greatest charge of each object."""
    a = F.atanh(c.beta / 1.01)
    hits = t.hits().select(*KEY, "t_idx", "x", "y", "beta", (a * a + Q_MIN).alias("q"), (5 + 50 * F.col("tax")).alias("d"))
    top = F.max_by(F.struct("hit_id", "x", "y", "q", "beta", "d"), F.struct("q", -F.col("hit_id")))
    alpha = hits.where("t_idx >= 0").groupBy(*OBJECT).agg(top.alias("t"))
    names = {"hit_id": "alpha_id", "x": "ax", "y": "ay", "q": "aq", "beta": "ab", "d": "ad"}
    return hits, alpha.select(*OBJECT, *(F.col(f"t.{a}").alias(b) for a, b in names.items()))


def scaled() -> Column:
    """Squared distance from an object's point in units of both widths, the point's above all."""
    dx, dy = c.x - F.col("ax"), c.y - F.col("ay")
    return (dx * dx + dy * dy) / (OWN * F.col("ad") * F.col("ad") + OTHER * F.col("d") * F.col("d") + 1e-4)


@query(on_hits(f"""SELECT event_id, t_idx, round((max(ab)+{Q_MIN}/10)*sum(CASE WHEN s = 0 THEN 0 ELSE -exp(-s/{WELL * WELL}/2) END*(beta+{Q_MIN}/10))/(count(*)+1e-3), 6) AS well,
  round(max(aq)*sum((1-exp(-s/(2*{ATT_SCALE * ATT_SCALE}))+0.1*sqrt(s+1e-6))*q)/(count(*)+1e-3), 5) AS pre_condensation FROM (SELECT qq.*, ab, aq, {WIDTHS} AS s FROM qq JOIN al USING (event_id, t_idx)) GROUP BY 1, 2""", CHARGES))
def potential_variants(t: Tables) -> DataFrame:
    """Attraction of objects as a probability well, by scores, and as before condensation, by charges."""
    hits, alpha = charges(t)
    rows = hits.join(alpha, OBJECT).withColumn("s", scaled())
    n = F.count("*") + 1e-3
    well = F.when(F.col("s") == 0, 0.0).otherwise(-F.exp(-F.col("s") / (WELL * WELL) / 2))
    pull = 1 - F.exp(-F.col("s") / (2 * ATT_SCALE * ATT_SCALE)) + 0.1 * F.sqrt(F.col("s") + 1e-6)
    return rows.groupBy(*OBJECT).agg(
        r((F.max("ab") + Q_MIN / 10) * F.sum(well * (c.beta + Q_MIN / 10)) / n).alias("well"), r(F.max("aq") * F.sum(pull * F.col("q")) / n, 5).alias("pre_condensation"),
    )


@query(on_edges(f"""SELECT al.event_id, al.t_idx, round(max(aq)*sum(CASE WHEN qq.t_idx <> al.t_idx THEN exp(-{WIDTHS}/2)*q ELSE 0 END)/({K}+1e-3), 6) AS rep
  FROM al JOIN edges e ON e.event_id = al.event_id AND e.hit_id = al.alpha_id JOIN qq ON qq.event_id = e.event_id AND qq.hit_id = e.nbr_id WHERE slot > 0 GROUP BY 1, 2""", CHARGES))
def potential_knn_repulsion(t: Tables) -> DataFrame:
    """Repulsion of the rows of others among the neighbours of each object's point, over all its slots."""
    hits, alpha = charges(t)
    near = edges(t).where("slot > 0").select("event_id", F.col("hit_id").alias("alpha_id"), "nbr_id")
    far = hits.select("event_id", F.col("hit_id").alias("nbr_id"), F.col("t_idx").alias("own"), "x", "y", "q", "d")
    rows = alpha.join(near, ["event_id", "alpha_id"]).join(far, ["event_id", "nbr_id"])
    push = F.when(F.col("own") != F.col("t_idx"), F.exp(-scaled() / 2) * F.col("q")).otherwise(0.0)
    return rows.groupBy(*OBJECT).agg(r(F.max("aq") * F.sum(push) / (K + 1e-3)).alias("rep"))


@query(on_hits("SELECT event_id, hit_id, round(CASE WHEN t_idx < 0 THEN beta ELSE coalesce(beta/nullif(m, 0), 0) END, 6) AS normed, round(CASE WHEN t_idx < 0 THEN 0 ELSE s/(n+1e-3) END, 6) AS penalty FROM (SELECT *, max(beta) OVER w AS m, sum(beta) OVER w AS s, count(*) OVER w AS n FROM hits WINDOW w AS (PARTITION BY event_id, t_idx))"))
def potential_normalised_beta(t: Tables) -> DataFrame:
    """Scores by their object's greatest one (noise keeps its own), and the mean score of the row's object."""
    o = t.hits().groupBy(*OBJECT).agg(F.max("beta").alias("m"), F.sum("beta").alias("s"), F.count("*").alias("n"))
    rows = t.hits().select(*KEY, "t_idx", "beta").join(o, OBJECT)
    noise = F.col("t_idx") < 0
    normed = F.when(noise, c.beta).otherwise(F.coalesce(F.try_divide("beta", "m"), F.lit(0.0)))
    return rows.select(*KEY, r(normed).alias("normed"), r(F.when(noise, 0.0).otherwise(F.col("s") / (F.col("n") + 1e-3))).alias("penalty"))


@query(on_edges(f"SELECT e.event_id, e.hit_id, round(sum(w*b.x)/{K}, 5) AS mean, round(CASE WHEN count(*) < {K} THEN greatest(max(w*b.x), 0) ELSE max(w*b.x) END, 5) AS max, arg_max(nbr_id, w*b.x - slot/1e9) AS arg FROM (SELECT *, 1/(1+dsq/10) AS w FROM edges) e JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id GROUP BY 1, 2"))
def accumulate_more_modes(t: Tables) -> DataFrame:
    """Mean over all slots and greatest value under weights that are given, and the neighbour that has it."""
    e = ed.with_neighbour(edges(t, "x"), t.hits(), "x").withColumn("v", 1 / (1 + F.col("dsq") / 10) * F.col("n_x"))
    top = F.when(F.count("*") < K, F.greatest(F.max("v"), F.lit(0.0))).otherwise(F.max("v"))
    return e.groupBy(*KEY).agg(r(F.sum("v") / K, 5).alias("mean"), r(top, 5).alias("max"), F.max_by("nbr_id", F.col("v") - F.col("slot") / 1e9).alias("arg"))


CLIP = "least(greatest(exp(-dsq/100)*0.98+0.01, 1e-7), 1-1e-7)"


@query(on_edges(f"""SELECT event_id, round(sum(v*w)/sum(w), 5) AS loss FROM (SELECT event_id, hit_id, max(w) AS w, avg((CASE WHEN same = 1 THEN -ln(p) ELSE -ln(1-p) END)*nw*2*(same*ws+(1-same)*(1-ws))) AS v
  FROM (SELECT *, 1-avg(same) OVER (PARTITION BY event_id) AS ws FROM (SELECT e.event_id, e.hit_id, {CLIP} AS p, CASE WHEN a.t_idx = b.t_idx AND b.t_idx >= 0 THEN 1.0::DOUBLE ELSE 0 END AS same,
  (1-least(5*b.tax, 1))*(1+ln(a.energy+b.energy+1)+1e-2)+1e-2 AS nw, (1-least(5*a.tax, 1))*(1+ln(a.energy+1)+1e-2)+1e-2 AS w FROM {NB} JOIN hits a ON a.event_id = e.event_id AND a.hit_id = e.hit_id WHERE slot > 0)) GROUP BY 1, 2) GROUP BY 1"""))
def classifier_losses(t: Tables) -> DataFrame:
    """Cross entropy of edges, weighted by the edge's energy, by how rare its class is in the event, and less where an end is a spectator."""

    def weight(energy: Column, spectator: Column) -> Column:
        return (1 - F.least(5 * spectator, F.lit(1.0))) * (1 + F.log(energy + 1) + 1e-2) + 1e-2

    carry = ("t_idx", "tax", "energy")
    e = kn.exploded(kn.lists(t.hits(), K, carry=carry), *carry, (F.size("near") - 1).alias("n")).where("slot > 0")
    p = F.least(F.greatest(F.exp(-F.col("dsq") / 100) * 0.98 + 0.01, F.lit(1e-7)), F.lit(1 - 1e-7))
    same = F.when((F.col("t_idx") == F.col("n_t_idx")) & (F.col("n_t_idx") >= 0), 1.0).otherwise(0.0)
    edge = e.select(*KEY, p.alias("p"), same.alias("same"), weight(c.energy + F.col("n_energy"), F.col("n_tax")).alias("nw"), weight(c.energy, F.col("tax")).alias("w"), "slot", "n")
    # The loss is linear in the classes' weights, so sums of both classes are enough and edges are read once. Each edge
    # brings its share of its row's mean, and the first one the row's weight, so that events are summed at once.
    part = lambda yes: F.sum(F.when(F.col("same") == yes, F.col("w") * (-F.log("p") if yes else -F.log(1 - F.col("p"))) * F.col("nw") / F.col("n")).otherwise(0.0))
    ws = 1 - F.avg("same")
    loss = (ws * part(1) + (1 - ws) * part(0)) * 2 / F.sum(F.when(F.col("slot") == 1, F.col("w")))
    return edge.groupBy("event_id").agg(r(loss, 5).alias("loss"))


def _met_by_join(hits: DataFrame, asks: Column) -> DataFrame:
    """event_id, score and share of the own object of rows of large events that ask: rows and those who ask meet in cells."""
    hits = hits.withColumn("score", F.col("beta"))
    asked = hits.where(asks).withColumn("level", rounds.radius_level(F.col("radius")))
    met = rounds.covering(hits, asked, ("x", "y", "z")).where("dsq < radius * radius").select("event_id", "hit_id", "point", "score")
    own = hits.select("event_id", F.col("hit_id").alias("point"), F.col("t_idx").alias("mine"))
    both = met.join(hits.select(*KEY, "t_idx"), KEY).join(own, ["event_id", "point"])
    same = F.sum(F.when(F.col("t_idx") == F.col("mine"), 1.0).otherwise(0.0))
    return both.groupBy("event_id", "point").agg(F.max("score").alias("s"), (same / (F.count("*") + 1e-3)).alias("p")).drop("point")


SAMPLED = "substr(md5('3-' || a.event_id || '-' || a.hit_id), 1, 1) < '4'"


@query(on_hits(f"""SELECT event_id, count(*) AS n, round(avg(-(p*ln(s)+(1-p)*ln(1-s))), 5) AS loss, round(1-avg(p), 6) AS contamination FROM (SELECT a.event_id, a.hit_id, least(greatest(max(a.beta), 1e-7), 1-1e-7) AS s, sum(CASE WHEN a.t_idx = b.t_idx THEN 1.0::DOUBLE ELSE 0 END)/(count(*)+1e-3) AS p
  FROM hits a JOIN hits b ON a.event_id = b.event_id AND {DSQ} < (6+8*a.beta)*(6+8*a.beta) WHERE {SAMPLED} GROUP BY 1, 2) GROUP BY 1"""))
def neighbour_contamination(t: Tables) -> DataFrame:
    """How many of the rows within each row's own distance are of its object, on a seeded sample of rows, and the cross entropy of its score with that."""
    hits = t.hits().select(*KEY, "x", "y", "z", "beta", "t_idx", (6 + 8 * c.beta).alias("radius"))
    asks = F.substring(sel.seeded(3, *KEY), 1, 1) < "4"
    large = large_events(hits, kn.SMALL)
    small = hits if large is None else hits.join(large, "event_id", "left_anti")
    same = F.size(F.filter("near", lambda n: n["n_t_idx"] == F.col("t_idx")))
    row = kn.within(small, "radius", probes=asks, carry=("beta", "t_idx")).select("event_id", F.col("beta").alias("s"), (same / (F.size("near") + 1e-3)).alias("p"))
    if large is not None:
        row = row.unionByName(_met_by_join(hits.join(large, "event_id", "left_semi"), asks))
    s, p = F.least(F.greatest("s", F.lit(1e-7)), F.lit(1 - 1e-7)), F.col("p")
    return row.groupBy("event_id").agg(F.count("*").alias("n"), r(F.avg(-(p * F.log(s) + (1 - p) * F.log(1 - s))), 5).alias("loss"), r(1 - F.avg(p)).alias("contamination"))


def _nodes(rows: DataFrame, labels: dict[str, tuple[str, int]]) -> DataFrame:
    """Objects of every kind at the place of their best row, with their energy on its side. labels: of each kind, the column and what its numbers are moved by."""
    of = [F.struct(F.lit(kind).alias("kind"), F.col(label).cast("long").alias("label"), (F.col(label) + shift).cast("long").alias("id")) for kind, (label, shift) in labels.items()]
    each = rows.select("event_id", "hit_id", "x", "y", "z", "beta", "energy", F.explode(F.array(*of)).alias("o")).where("o.label >= 0")
    o = each.groupBy("event_id", F.col("o.kind").alias("kind"), F.col("o.id").alias("id")).agg(F.max_by(F.struct("x", "y", "z"), F.struct("beta", -F.col("hit_id"))).alias("p"), F.sum("energy").alias("e"))
    return o.select("event_id", F.col("id").alias("hit_id"), "p.*", *(F.when(F.col("kind") == kind, F.col("e")).otherwise(0.0).alias(kind) for kind in labels))


UNION = """nodes AS (SELECT event_id, t_idx::BIGINT AS hit_id, arg_max(x, (beta, -hit_id)) AS x, arg_max(y, (beta, -hit_id)) AS y, arg_max(z, (beta, -hit_id)) AS z, 0.0::DOUBLE AS rec, sum(energy) AS tru FROM hits WHERE t_idx >= 0 GROUP BY event_id, t_idx
    UNION ALL SELECT event_id, floor(x/17)::BIGINT + 1000 AS hit_id, arg_max(x, (beta, -hit_id)), arg_max(y, (beta, -hit_id)), arg_max(z, (beta, -hit_id)), sum(energy), 0.0 FROM hits GROUP BY event_id, floor(x/17))"""


@query(on_hits("""SELECT count(*) AS n, round(max(scale), 5) AS scale, round(abs(avg((rec-tru)/(tru+1e-2))), 4) AS loss FROM (SELECT e.event_id, e.hit_id, max(scale) AS scale, sum(exp(-3*dsq/scale)*b.rec) AS rec, sum(exp(-3*dsq/scale)*b.tru) AS tru
  FROM edges e JOIN nodes b ON b.event_id = e.event_id AND b.hit_id = e.nbr_id, (SELECT avg(far) AS scale FROM (SELECT max(dsq) AS far FROM edges GROUP BY event_id, hit_id)) GROUP BY 1, 2)""", UNION, edges_sql(3).replace("FROM hits a JOIN hits b", "FROM nodes a JOIN nodes b")))
def local_energy_conservation(t: Tables) -> DataFrame:
    """Predicted against true energy around every object of either kind: neighbours in the union of both, distances by the mean of farthest ones."""
    # Written, as the search for large events reads them first, and would else have the rows numbered and shuffled twice.
    nodes = stored(_nodes(predicted(t), {"true": ("t_idx", 0), "rec": ("pred", 1000)}))
    # Written too: the scale needs all edges before the first one can be weighed.
    near = stored(kn.knn(nodes, 3, carry=("rec", "true")).groupBy(*KEY).agg(F.max("dsq").alias("far"), F.collect_list(F.struct("dsq", "n_rec", "n_true")).alias("near")))
    scale = near.agg(F.avg("far").alias("scale"))

    def total(name: str) -> Column:
        terms = F.filter(F.transform("near", lambda n: F.exp(-3 * n["dsq"] / F.col("scale")) * n[name]), lambda v: v.isNotNull())
        return F.when(F.size(terms) > 0, F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))

    around = near.crossJoin(F.broadcast(scale)).select("scale", total("n_rec").alias("rec"), total("n_true").alias("true"))  # one row is broadcast
    relative = (F.col("rec") - F.col("true")) / (F.col("true") + 1e-2)
    return around.agg(F.count("*").alias("n"), r(F.max("scale"), 5).alias("scale"), r(F.abs(F.avg(relative)), 4).alias("loss"))


# Features in their order, with the mean and the spread that they are brought to.
FEATURES = ["energy", "eta", "is_track", "theta", "r", "x", "y", "z", "time"]
MEANS = [0.0740814656, 2.46156192, 0.0, 0.207392946, 3.55599976, 0.0609507263, -0.00401970092, -0.515379727, 0.0874295086]
SPREADS = [0.299679846, 0.382687777, 1.0, 0.0841238275, 0.250777304, 0.485394388, 0.518072903, 0.240222782, 0.194716245]
MADE = {
    "energy": "energy", "eta": "abs(x/20-1)", "is_track": "CAST(is_track AS DOUBLE)", "theta": "2*atan(exp(-abs(x/20-1)))", "r": "sqrt(x*x+y*y+z*z)/100", "x": "x/100", "y": "y/100",
    "z": "(abs(z-20)-400)/100", "time": "greatest(tax-0.02, 0)/10",
}


@query(on_hits("SELECT event_id, hit_id, " + ", ".join(f"round((({MADE[f]})-({m}))/{s}, 6) AS {f}" for f, m, s in zip(FEATURES, MEANS, SPREADS)) + " FROM hits"))
def standardised_features(t: Tables) -> DataFrame:
    """All nine features, absolute and scaled where they are to be, about fixed means in units of fixed spreads."""
    x, y, z, eta = c.x, c.y, F.col("z"), F.abs(c.x / 20 - 1)
    made = {
        "energy": c.energy, "eta": eta, "is_track": F.col("is_track").cast("double"), "theta": 2 * F.atan(F.exp(-eta)), "r": F.sqrt(x * x + y * y + z * z) / 100, "x": x / 100, "y": y / 100,
        "z": (F.abs(z - 20) - 400) / 100, "time": F.greatest(F.col("tax") - 0.02, F.lit(0.0)) / 10,
    }
    return t.hits().select(*KEY, *(r((made[f] - m) / s).alias(f) for f, m, s in zip(FEATURES, MEANS, SPREADS)))


# Up rows: a threshold that the least of the events' best scores may lower, and rows that are promoted in any case.
PROMOTED, UP_LEAST, LOWERED = "is_track", 0.8, 0.98
RAISED = f"""rs AS (SELECT *, CASE WHEN {PROMOTED} THEN 1.0::DOUBLE ELSE beta END AS score FROM hits),
  th AS (SELECT least({UP_LEAST}::DOUBLE, {LOWERED}*min(m)) AS threshold FROM (SELECT max(score) AS m FROM rs GROUP BY event_id))"""


def raised(t: Tables) -> DataFrame:
    """Hits with score (promoted ones: 1) and up."""
    hits = t.hits().withColumn("score", F.when(F.col(PROMOTED), 1.0).otherwise(c.beta))
    threshold = hits.groupBy("event_id").agg(F.max("score").alias("m")).agg(F.least(F.lit(UP_LEAST), LOWERED * F.min("m")).alias("threshold"))
    return hits.crossJoin(F.broadcast(threshold)).withColumn("up", F.col("score") >= F.col("threshold"))  # one row is broadcast


@query(on_hits("SELECT event_id, hit_id, round(x, 5) AS x, round(energy, 5) AS energy, is_track FROM rs, th WHERE score >= threshold", RAISED))
def select_up(t: Tables) -> DataFrame:
    """Features of the up rows: those above the threshold, as far as every event keeps one, and those that are promoted."""
    return raised(t).where("up").select(*KEY, r("x", 5).alias("x"), r("energy", 5).alias("energy"), "is_track")


DOWNWARDS = edges_sql(3, f"a.event_id = b.event_id AND NOT a.{PROMOTED} AND a.beta <= {UP_LEAST} AND NOT b.{PROMOTED} AND b.beta > {UP_LEAST}", "down")


@query(on_hits("SELECT event_id, hit_id, nbr_id AS up_id, slot, round(dsq, 5) AS dsq, round(exp(exp(-dsq))/(sum(exp(exp(-dsq))) OVER w + (3 - count(*) OVER w)*exp(1.0)), 6) AS weight FROM down WINDOW w AS (PARTITION BY event_id, hit_id)", DOWNWARDS))
def graph_condensation(t: Tables) -> DataFrame:
    """Edges from rows below the threshold to those above it, nearest first; promoted rows are apart. Weights are a softmax over all slots: a missing one counts as distance 0."""
    free = ~F.col(PROMOTED)
    near = kn.knn(t.hits(), 3, probes=free & (c.beta <= UP_LEAST), neighbours=free & (c.beta > UP_LEAST), own="none")
    e, w = F.exp(F.exp(-F.col("dsq"))), Window.partitionBy(*KEY)
    weight = e / (F.sum(e).over(w) + (3 - F.count("*").over(w)) * F.exp(F.lit(1.0)))
    return near.select(*KEY, F.col("nbr_id").alias("up_id"), F.col("slot").cast("long").alias("slot"), r("dsq", 5).alias("dsq"), r(weight).alias("weight"))
