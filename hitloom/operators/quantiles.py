"""Exact quantiles by narrowing: count, keep the range that holds the wanted place, count again.

No buffer holds a group's values. Each step counts the values of a range in equal bins, with the least and the
greatest value of each bin, and goes on with the bin that holds the place. A bin of one value is an answer, however
many rows share it. What is left after the last step is sorted and numbered by group and place, which may spill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a step, and steps.
BINS, STEPS = 2048, 2


def quantiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, share and quantile: the exact quantiles of value for each group, with linear interpolation between neighbours.

    Null and NaN values count nowhere; groups without values have no rows. Null group keys are a group.
    """
    rows = rows.select(F.struct(*by).alias("_key") if by else F.lit(0).alias("_key"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    rows = rows.withColumn("_v", F.col("_v") + 0.0)  # one zero
    ends = rows.groupBy("_key").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    share = F.explode(F.array(*(F.lit(float(s)) for s in shares)))
    place = F.col("share") * (F.col("n") - 1)
    wanted = ends.select("_key", "n", "lo", "hi", share.alias("share"))
    wanted = wanted.select("_key", "share", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("place"), "lo", "hi", F.lit(0).cast("long").alias("ahead"))
    # Ranges are few: one for each group, share and side.
    for _ in range(STEPS):
        ranges = wanted.where("lo < hi").select(F.col("_key").alias("_k"), "lo", "hi").distinct()
        inside = rows.join(ranges, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).select("_key", "lo", "hi", "_v")
        # Halves before the difference, which may be more than a double holds.
        width = F.col("hi") / 2 - F.col("lo") / 2
        at = F.least(F.floor((F.col("_v") / 2 - F.col("lo") / 2) / width * BINS), F.lit(BINS - 1))
        counts = inside.groupBy("_key", "lo", "hi", at.alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        above = Window.partitionBy("_key", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(above), F.lit(0)))
        w, c = wanted.alias("w"), counts.alias("c")
        here = (F.col("w._key").eqNullSafe(F.col("c._key"))) & (F.col("w.lo") == F.col("c.lo")) & (F.col("w.hi") == F.col("c.hi"))
        rank = F.col("w.place") - F.col("w.ahead")
        found = w.join(c, here & (F.col("c.before") <= rank) & (rank < F.col("c.before") + F.col("c.c")), "left")
        known = F.col("c.bin").isNull()
        wanted = found.select(
            F.col("w._key").alias("_key"), "share", "place", F.when(known, F.col("w.lo")).otherwise(F.col("c.least")).alias("lo"),
            F.when(known, F.col("w.hi")).otherwise(F.col("c.most")).alias("hi"), F.when(known, F.col("w.ahead")).otherwise(F.col("w.ahead") + F.col("c.before")).alias("ahead"),
        )
    open_ = wanted.where("lo < hi").alias("w")
    left = rows.alias("r").join(open_, (F.col("r._key").eqNullSafe(F.col("w._key"))) & (F.col("r._v") >= F.col("w.lo")) & (F.col("r._v") <= F.col("w.hi")))
    number = F.row_number().over(Window.partitionBy("w._key", "share", "place").orderBy("_v")) - 1
    last = left.withColumn("_rn", number).where(F.col("_rn") == F.col("place") - F.col("ahead")).select(F.col("w._key").alias("_key"), "share", "place", F.col("_v").alias("value"))
    told = wanted.where("lo >= hi").select("_key", "share", "place", F.col("lo").alias("value")).unionByName(last)
    sides = told.join(ends.select(F.col("_key").alias("_k"), "n"), F.col("_key").eqNullSafe(F.col("_k"))).groupBy("_key", "share", "n").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    part = F.col("share") * (F.col("n") - 1) - F.floor(F.col("share") * (F.col("n") - 1))
    return sides.select(*(F.col(f"_key.{c}").alias(c) for c in by), "share", (F.col("a") + (F.col("b") - F.col("a")) * part).alias("quantile"))


def wide(told: DataFrame, shares: Sequence[float], names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """quantiles() with one row for each group and a column for each share."""
    picked: list[Column] = [F.max(F.when(F.col("share") == float(s), F.col("quantile"))).alias(n) for s, n in zip(shares, names)]
    return told.groupBy(*by).agg(*picked)
