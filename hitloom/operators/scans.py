"""Running sums, ranks and recurrences inside events by parts: no window spans an event.

An event's rows are cut into parts of bounded length by their position, or into ranges of what they are ordered by. Totals of
parts are few; they give each part what comes before it, and the rest happens inside parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a part.
PART = 4096


def _before(totals: DataFrame, by: Sequence[str], part: str, sums: dict[str, str]) -> DataFrame:
    """What lies before each part: sums of columns over the parts ahead of it. A part is one row here."""
    ahead = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, part, *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(new) for c, new in sums.items()))


def numbered(rows: DataFrame, first: str, then: Sequence[Column | str], name: str, by: Sequence[str] = ("event_id",), descending: bool = False, part: int = PART) -> DataFrame:
    """rows with name: 1, 2, ... in the order of first (a number), then of then. Nulls come last.

    Parts are ranges of equal width of first, about one for each part rows; rows that share one value of first share a part.
    """
    value = F.col(first).cast("double")
    span = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / part)
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((value - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts), parts - 1)).otherwise(0)
    at = F.when(value.isNull(), parts).otherwise(parts - 1 - at if descending else at)
    ranged = rows.join(span, list(by)).withColumn("_part", at).drop("_lo", "_hi", "_n")
    before = _before(ranged.groupBy(*by, "_part").agg(F.count("*").alias("_c")), by, "_part", {"_c": "_ahead"})
    inside = Window.partitionBy(*by, "_part").orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last(), *then)
    out = ranged.withColumn("_own", F.row_number().over(inside)).join(before, [*by, "_part"])
    return out.withColumn(name, F.col("_ahead") + F.col("_own")).drop("_part", "_own", "_ahead")


def running_sum(rows: DataFrame, position: str, value: str, name: str, by: Sequence[str] = ("event_id",), part: int = PART) -> DataFrame:
    """rows with name: the sum of value up to and with each row, by position (1, 2, ...)."""
    parted = rows.withColumn("_part", F.floor((F.col(position) - 1) / part))
    before = _before(parted.groupBy(*by, "_part").agg(F.sum(value).alias("_s")), by, "_part", {"_s": "_ahead"})
    inside = Window.partitionBy(*by, "_part").orderBy(position)
    out = parted.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(before, [*by, "_part"])
    return out.withColumn(name, F.col("_ahead") + F.col("_own")).drop("_part", "_own", "_ahead")


def moving_sum(rows: DataFrame, position: str, value: str, before: int, after: int, name: str, by: Sequence[str] = ("event_id",), part: int = PART) -> DataFrame:
    """rows with name: the sum of value from so many positions before to so many after (1, 2, ... without gaps; what is missing counts 0).

    Rows near the border of a part are also sent to the parts whose sums they belong to.
    """
    own = F.floor((F.col(position) - 1) / part)
    reach = F.sequence(F.floor((F.col(position) - 1 - after) / part), F.floor((F.col(position) - 1 + before) / part))
    sent = rows.withColumn("_part", F.explode(reach))
    window = Window.partitionBy(*by, "_part").orderBy(position).rangeBetween(-before, after)
    return sent.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0))).where(F.col("_part") == own).drop("_part")


def affine_scan(rows: DataFrame, position: str, factor: Column, term: Column, name: str, by: Sequence[str] = ("event_id",), part: int = PART, depth: int = 2) -> DataFrame:
    """rows with name: y of the recurrence y = factor * y + term along position (1, 2, ...), from 0.

    Each row is a map; maps of a part compose to one, again an affine map. The maps of parts are scanned in the same way, depth
    times, and what remains then (one map for part ** depth rows) in one array; with what comes before it each part runs on its own.
    A part's rows are in an array of bounded length.
    """
    maps = rows.withColumns({"_a": factor.cast("double"), "_b": term.cast("double"), "_part": F.floor((F.col(position) - 1) / part)})
    lists = maps.groupBy(*by, "_part").agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col("_a").alias("a"), F.col("_b").alias("b")))).alias("_maps"))
    one = F.aggregate("_maps", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), lambda m, x: F.struct((x["a"] * m["a"]).alias("a"), (x["a"] * m["b"] + x["b"]).alias("b")))
    whole = lists.select(*by, (F.col("_part") + 1).alias("_at"), one.alias("_m")).select(*by, "_at", F.col("_m.a").alias("_fa"), F.col("_m.b").alias("_fb"))
    if depth:
        scanned = affine_scan(whole, "_at", F.col("_fa"), F.col("_fb"), "_y", by, part, depth - 1).select(*by, "_at", "_y")
    else:
        all_maps = whole.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_at", "_fa", "_fb"))).alias("_maps"))
        scanned = _run(all_maps, by, "_maps", F.lit(0.0)).select(*by, F.col("p").alias("_at"), F.col("y").alias("_y"))
    start = scanned.select(*by, F.col("_at").alias("_part"), F.col("_y").alias("_start"))  # what a part leaves is where the next one starts
    lists = lists.join(start, [*by, "_part"], "left")
    told = _run(lists, by, "_maps", F.coalesce("_start", F.lit(0.0)))
    return rows.join(told.select(*by, F.col("p").alias(position), F.col("y").alias(name)), [*by, position])


def _run(lists: DataFrame, by: Sequence[str], maps: str, start: Column) -> DataFrame:
    """(p, y) of each map of an array of (position, factor, term), one after the other from start."""
    empty = F.array().cast("array<struct<p:bigint,y:double>>")
    first = F.struct(start.alias("y"), empty.alias("out"))

    def step(held: Column, x: Column) -> Column:
        p, a, b = (x.getField(n) for n in (("p", "a", "b") if maps_named else ("_at", "_fa", "_fb")))
        y = a * held["y"] + b
        return F.struct(y.alias("y"), F.concat(held["out"], F.array(F.struct(p.cast("long").alias("p"), y.alias("y")))).alias("out"))

    maps_named = "p" in lists.schema[maps].dataType.elementType.names
    return lists.select(*by, F.explode(F.aggregate(maps, first, step, lambda held: held["out"])).alias("_o")).select(*by, "_o.p", "_o.y")
