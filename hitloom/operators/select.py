"""Selections with guarantees, and the maps that lead back to all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hitloom.operators.scans import numbered


def event() -> WindowSpec:
    return Window.partitionBy("event_id")


def select_threshold(hits: DataFrame, score: str, threshold: float) -> DataFrame:
    """Rows with score >= threshold, and the best (first of equals) of an event that has none."""
    order = event().orderBy(F.desc(score), "hit_id")
    rows = hits.withColumn("_rn", F.row_number().over(order))
    return rows.where((F.col(score) >= threshold) | (F.col("_rn") == 1)).drop("_rn")


def select_lowered(hits: DataFrame, score: str, threshold: float, hardness: float = 20.0) -> DataFrame:
    """One threshold for all, low enough that each event keeps a row; weight is soft around it."""
    least = hits.groupBy("event_id").agg(F.max(score).alias("m")).agg(F.least(F.lit(threshold), F.min("m") - 1e-6).alias("thr"))
    rows = hits.crossJoin(F.broadcast(least)).where(F.col(score) >= F.col("thr"))  # one row is broadcast
    return rows.withColumn("weight", 1 / (1 + F.exp(-hardness * (F.col(score) - 4.6 / hardness - F.col("thr")))))


def noise_filter(hits: DataFrame, score: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Kept rows (score above threshold, or the event's least), and the map old_id -> new row for all rows.

    Rows that are dropped map to the first row with their event's least score.
    """
    rows = hits.withColumn("_least", F.min(score).over(event()))
    rows = rows.withColumn("_first", F.min(F.when(F.col(score) == F.col("_least"), F.col("hit_id"))).over(event()))
    keep = (F.col(score) > threshold) | (F.col(score) == F.col("_least"))
    mapping = rows.select("event_id", "hit_id", F.when(keep, F.col("hit_id")).otherwise(F.col("_first")).alias("new_id"))
    return rows.where(keep).drop("_least", "_first"), mapping


def back_gather(mapping: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
    """Values of the new rows on all old rows."""
    return mapping.join(values.select("event_id", F.col("hit_id").alias("new_id"), *columns), ["event_id", "new_id"])


def back_scatter(hits: DataFrame, values: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Values at their own rows only, defaults at all others."""
    kept = values.select("event_id", "hit_id", *(F.col(c).alias(f"_{c}") for c in defaults))
    out = hits.select("event_id", "hit_id").join(kept, ["event_id", "hit_id"], "left")
    return out.select("event_id", "hit_id", *(F.coalesce(f"_{c}", F.lit(d)).alias(c) for c, d in defaults.items()))


def seeded(seed: int, *keys: str) -> Column:
    """A text that orders rows at random, the same for equal seeds and keys."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *keys).cast("binary"))


def downsample(hits: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n rows of each event, at random."""
    order = event().orderBy(seeded(seed, "event_id", "hit_id"), "hit_id")
    return hits.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def shuffled(events: DataFrame, seed: int) -> DataFrame:
    """event_id and place of distinct events in a seeded random order.

    Ranges of the hash, as many as the number of events asks for, are ordered apart; only their sizes are summed in one task.
    """
    rows = events.select("event_id", seeded(seed, "event_id").alias("_h"), F.lit(0).alias("_all"))
    rows = rows.withColumn("_v", F.conv(F.substring("_h", 1, 12), 16, 10).cast("double"))  # exact in a double
    return numbered(rows, "_v", ["_h", "event_id"], "_at", by=("_all",)).select("event_id", (F.col("_at") - 1).cast("long").alias("place"))


def without_pile_up(frame: DataFrame, least: int) -> DataFrame:
    """Rows whose true object is numbered below least; those without one go too."""
    return frame.where(F.col("t_idx") < least)


def chained(first: DataFrame, second: DataFrame) -> DataFrame:
    """The map of two filters that follow each other."""
    then = second.select("event_id", F.col("hit_id").alias("new_id"), F.col("new_id").alias("_top"))
    return first.join(then, ["event_id", "new_id"]).select("event_id", "hit_id", F.col("_top").alias("new_id"))


def removed_at(hits: DataFrame, kept: list[DataFrame]) -> DataFrame:
    """removed_at: the number of the first filter, from 1, that a row did not pass; 0 where it passed all."""
    passed = None
    for k, rows in enumerate(kept, 1):
        one = rows.select("event_id", "hit_id", F.lit(k).alias("_k"))
        passed = one if passed is None else passed.unionByName(one)
    last = passed.groupBy("event_id", "hit_id").agg(F.max("_k").alias("_k"))
    out = hits.select("event_id", "hit_id").join(last, ["event_id", "hit_id"], "left")
    return out.select("event_id", "hit_id", F.when(F.col("_k") == len(kept), 0).otherwise(F.coalesce("_k", F.lit(0)) + 1).alias("removed_at"))


def select_lowered_twice(hits: DataFrame, score: str, threshold: float, hardness: float = 20.0, below: float = 1e-2) -> DataFrame:
    """Rows from thr on, with a soft weight: thr is the threshold, or the event's best score if that is lower, or just below
    the least best score of all events if that is lower still."""
    best = hits.groupBy("event_id").agg(F.max(score).alias("_m"))
    least = best.agg((F.min("_m") - below).alias("_all"))
    rows = hits.join(best, "event_id").crossJoin(F.broadcast(least))  # one row is broadcast
    rows = rows.withColumn("thr", F.least(F.lit(threshold), "_m", "_all")).where(F.col(score) >= F.col("thr"))
    return rows.withColumn("weight", 1 / (1 + F.exp(-hardness * (F.col(score) - 4.6 / hardness - F.col("thr"))))).drop("_m", "_all")


def past_marks(rows: DataFrame, cache: DataFrame, experiment: str, order: str) -> DataFrame:
    """Rows beyond the greatest value of order that the cache holds of their experiment; all rows of experiments that it lacks."""
    marks = cache.groupBy(experiment).agg(F.max(order).alias("_mark"))
    return rows.join(marks, experiment, "left").where(F.col("_mark").isNull() | (F.col(order) > F.col("_mark"))).drop("_mark")


def paged(rows: DataFrame, by: Sequence[str], value: str, length: int, name: str) -> DataFrame:
    """The values of each group in pages of length: by, page (0, 1, ...), name (an array in ascending order), n (the page's values).

    No array follows the size of a group.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1
    pages = rows.withColumn("page", F.floor(place / length)).groupBy(*by, "page")
    return pages.agg(F.array_sort(F.collect_list(value)).alias(name), F.count("*").alias("n"))
