"""Sequential rules as rounds of joins, for events that no task should hold.

All rules here pick rows in an order, and a row is picked if no earlier pick covers it. Whatever has no earlier
open row that may cover it is picked at once; what the picks cover is settled, and the rest goes on to the next round. So
the outcome is that of the sequential rule, in as many rounds as the longest chain of rows that wait for one another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.session import removed, stored

KEY = ["event_id", "hit_id"]
#: The narrowest cells, as a power of two: rows of no radius cover what shares their place.
LOWEST = -40


def dropped(*tables: DataFrame) -> None:
    for table in tables:
        removed(table.sparkSession, table.stored_path)


def earlier(a: str, b: str) -> Column:
    """Higher score first, then the smaller id."""
    return (F.col(f"{a}_score") > F.col(f"{b}_score")) | ((F.col(f"{a}_score") == F.col(f"{b}_score")) & (F.col(f"{a}_id") < F.col(f"{b}_id")))


def first_in_order(rows: DataFrame, covers: DataFrame) -> DataFrame:
    """Of rows(event_id, hit_id, score), best score first, those that no earlier pick covers: event_id, hit_id.

    covers(event_id, a_id, b_id): a covers b, if a is picked. Only pairs of open rows are kept from round to round.
    """
    ends = [rows.select("event_id", F.col("hit_id").alias(f"{s}_id"), F.col("score").alias(f"{s}_score")) for s in "ab"]
    pairs = covers.select("event_id", "a_id", "b_id").distinct().join(ends[0], ["event_id", "a_id"]).join(ends[1], ["event_id", "b_id"])
    pairs = stored(pairs.where(earlier("a", "b")).select("event_id", "a_id", "b_id"))
    open_ = stored(rows.select(*KEY))
    picks: list[DataFrame] = []
    while not pairs.isEmpty():
        waits = pairs.select("event_id", F.col("b_id").alias("hit_id")).distinct()
        new = stored(open_.join(waits, KEY, "left_anti"))
        covered = pairs.join(new.withColumnRenamed("hit_id", "a_id"), ["event_id", "a_id"], "left_semi").select("event_id", F.col("b_id").alias("hit_id"))
        settled = new.unionByName(covered).distinct()
        rest = stored(open_.join(settled, KEY, "left_anti"))
        left = pairs
        for end in ("a_id", "b_id"):
            left = left.join(rest.withColumnRenamed("hit_id", end), ["event_id", end], "left_semi")
        left = stored(left)
        dropped(pairs, open_)
        pairs, open_ = left, rest
        picks.append(new)
    dropped(pairs)
    for new in picks:
        open_ = open_.unionByName(new)
    return open_


def parts(links: DataFrame) -> DataFrame:
    """Connected parts of links(event_id, a, b) inside events: (event_id, node, part), part being the part's smallest node.

    Nodes pass their label on to neighbours and take their label's label, so rounds grow with the logarithm of a part's diameter.
    """
    both = links.select("event_id", "a", "b").unionByName(links.select("event_id", F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct())
    labels = stored(both.groupBy("event_id", F.col("a").alias("node")).agg(F.min("b").alias("low")).select("event_id", "node", F.least("node", "low").alias("part")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), ["event_id", "b"]).groupBy("event_id", F.col("a").alias("node")).agg(F.min("part").alias("near"))
        spread = labels.join(near, ["event_id", "node"]).select("event_id", "node", F.least("near", "part").alias("part"), F.col("part").alias("old"))
        above = labels.select("event_id", F.col("node").alias("part"), F.col("part").alias("top"))
        step = stored(spread.join(above, ["event_id", "part"], "left").select("event_id", "node", F.least("part", F.coalesce("top", "part")).alias("part"), "old"))
        dropped(labels)
        labels = step
        if labels.where("part <> old").isEmpty():
            dropped(both)
            return labels.drop("old")


def _cells(coords: Sequence[str], level: str) -> list[Column]:
    return [F.floor(F.col(c) / F.pow(F.lit(2.0), F.col(level) + 1)).alias(f"c_{c}") for c in coords]


def _around(rows: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Each row in the cells that touch its own, too."""
    for c in cells:
        rows = rows.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    return rows


def condensation_points(candidates: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Points among candidates(event_id, hit_id, score, radius, level, coords...): the same columns.

    A cell of a level is at least as wide as the radii of that level, so what a row covers lies in its own cell or in those
    that touch it. Only the best open row of a cell speaks for it: it is a point if the best of all cells around, of any
    level, are worse. The others wait, even if nothing covers them. No pairs of rows are made but of cells' best and of points.
    """
    cells = [f"c_{c}" for c in coords]
    key = ["event_id", "level", *cells]
    levels = [r.level for r in candidates.select("level").distinct().collect()]  # powers of two of radii: few
    every = F.explode(F.array(*(F.lit(x) for x in levels)) if levels else F.array().cast("array<int>"))
    open_ = stored(candidates)
    found: list[DataFrame] = []
    while not open_.isEmpty():
        own = open_.select("*", *_cells(coords, "level"))
        best = own.groupBy(*key).agg(F.max_by(F.struct(*KEY[1:], "score", "radius", *coords), F.struct("score", -F.col("hit_id"))).alias("best")).select(*key, "best.*")
        named = best.select(*key, F.col("hit_id").alias("a_id"), F.col("score").alias("a_score"))
        asked = best.select(*KEY, F.col("hit_id").alias("b_id"), F.col("score").alias("b_score"), *coords, every.alias("level"))
        asked = _around(asked.select("*", *_cells(coords, "level")), cells)
        waits = asked.join(named, key).where(earlier("a", "b")).select(*KEY).distinct()
        new = stored(best.select("event_id", "hit_id", "score", "radius", "level", *coords).join(waits, KEY, "left_anti"))
        # A better row that a point covers stays open: it comes before that point.
        taken = covering(open_, new, coords, levels).where((F.col("score") > F.col("own_score")) | ((F.col("score") == F.col("own_score")) & (F.col("point") < F.col("hit_id")))).select(*KEY).distinct()
        rest = stored(open_.join(taken.unionByName(new.select(*KEY)).distinct(), KEY, "left_anti"))
        dropped(open_)
        open_ = rest
        found.append(new)
    points = open_
    for new in found:
        points = points.unionByName(new)
    return points


def radius_level(radius: Column) -> Column:
    """The power of two below a radius."""
    return F.greatest(F.lit(LOWEST), F.coalesce(F.floor(F.log2(F.when(radius > 0, radius))), F.lit(LOWEST))).cast("int")


def covering(rows: DataFrame, points: DataFrame, coords: Sequence[str], levels: Sequence[int] | None = None) -> DataFrame:
    """Rows with the points that cover them: event_id, hit_id, own_score, point, dsq, and the point's score and radius.

    A join by each point's own radius: points look into the cells of their level (radius_level) that touch theirs. Rows stand in
    cells of all levels that their event has points of; levels names them, else they are part of the plan.
    """
    cells = [f"c_{c}" for c in coords]
    key = ["event_id", "level", *cells]
    at = rows.select(*KEY, F.col("score").alias("own_score"), *coords)
    if levels is None:
        at = at.join(points.select("event_id", "level").distinct(), "event_id")
    else:
        at = at.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels)) if levels else F.array().cast("array<int>")))
    at = at.select(*KEY, "own_score", "level", *_cells(coords, "level"), *(F.col(c).alias(f"b_{c}") for c in coords))
    reach = points.select("event_id", "level", *_cells(coords, "level"), F.col("hit_id").alias("point"), "score", "radius", *(F.col(c).alias(f"a_{c}") for c in coords))
    parts = [(F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in coords]
    pairs = at.join(_around(reach, cells), key).withColumn("dsq", sum(parts[1:], parts[0]))
    return pairs.where(F.col("dsq") <= F.col("radius") * F.col("radius")).select(*KEY, "own_score", "point", "dsq", "score", "radius")


def condensed(rows: DataFrame, coords: Sequence[str], threshold: float, max_beta: bool) -> DataFrame:
    """sid (-1: noise) and alpha_id of rows(event_id, hit_id, score, radius, coords...); rows with score above threshold may be points.

    Rows without a place cover nothing but themselves. A row goes through the points that cover it in their order, in an array.
    """
    level = radius_level(F.col("radius"))
    rows = rows.withColumns({"radius": F.coalesce(F.nanvl(F.abs("radius"), F.lit(0.0)), F.lit(0.0)), **{c: F.when(~F.isnan(c), F.col(c)) for c in ("score", *coords)}})
    placed = F.lit(True)
    for c in coords:
        placed = placed & F.col(c).isNotNull()
    may = rows.where(F.col("score") > threshold).withColumn("level", level).select(*KEY, "score", "radius", "level", *coords)
    points = condensation_points(may.where(placed), coords).unionByName(may.where(~placed))
    levels = [r.level for r in points.select("level").distinct().collect()]
    met = covering(rows.where(placed), points.where(placed), coords, levels)
    lone = points.where(~placed).select(*KEY, F.col("score").alias("own_score"), F.col("hit_id").alias("point"), F.lit(0.0).alias("dsq"), "score", "radius")
    number = points.select("event_id", F.col("hit_id").alias("point"), (F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("score"), "hit_id")) - 1).alias("sid"))
    met = met.unionByName(lone).join(number, ["event_id", "point"])
    if max_beta:
        told = met.groupBy(*KEY).agg(F.min(F.struct("sid", "point")).alias("t"))
    else:
        walk = F.sort_array(F.collect_list(F.struct("sid", "point", "dsq", (F.col("radius") * F.col("radius")).alias("rsq"))))
        start = F.struct(F.lit(-1).alias("sid"), F.lit(None).cast("long").alias("point"), F.lit(1e21).alias("dsq"))
        step = lambda held, m: F.when(held["dsq"] * m["rsq"] >= m["dsq"], F.struct(m["sid"].alias("sid"), m["point"].alias("point"), m["dsq"].alias("dsq"))).otherwise(held)
        told = met.groupBy(*KEY).agg(walk.alias("w")).select(*KEY, F.aggregate("w", start, step).alias("t"))
    told = told.select(*KEY, F.col("t.sid").alias("sid"), F.col("t.point").alias("alpha_id"))
    return rows.select(*KEY).join(told, KEY, "left").select(*KEY, F.coalesce("sid", F.lit(-1)).alias("sid"), "alpha_id")
