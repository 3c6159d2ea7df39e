"""Aggregates over edge tables (event_id, hit_id, nbr_id, dsq, slot)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.operators.knn import exploded

KEY = ["event_id", "hit_id"]


def with_neighbour(edges: DataFrame, hits: DataFrame, *features: str, prefix: str = "n_") -> DataFrame:
    """Edges with features of the neighbour, looked up unless the edges carry them."""
    features = tuple(f for f in features if f"{prefix}{f}" not in edges.columns)
    if not features:
        return edges
    far = hits.select("event_id", F.col("hit_id").alias("nbr_id"), *(F.col(f).alias(f"{prefix}{f}") for f in features))
    return edges.join(far, ["event_id", "nbr_id"])


def with_own(edges: DataFrame, hits: DataFrame, *features: str) -> DataFrame:
    """Edges with features of the row itself, looked up unless the edges carry them."""
    features = tuple(f for f in features if f not in edges.columns)
    return edges.join(hits.select(*KEY, *features), KEY) if features else edges


def accumulate(edges: DataFrame, hits: DataFrame, feature: str, k: int, weight: Column | None = None) -> DataFrame:
    """Weighted mean over k slots (missing ones count as 0), maximum (0 at least where slots are missing), and its neighbour."""
    w = F.exp(-F.col("dsq")) if weight is None else weight
    e = with_neighbour(edges, hits, feature).withColumn("v", w * F.col(f"n_{feature}"))
    return e.groupBy(*KEY).agg((F.sum("v") / k).alias("mean"), F.max("v").alias("max"), F.max_by("nbr_id", F.struct(F.col("v"), -F.col("nbr_id"))).alias("arg"))


def push_sum(edges: DataFrame, hits: DataFrame, feature: str, weight: Column) -> DataFrame:
    """Each row adds weight * feature to its neighbours; rows that get nothing have 0."""
    sent = with_own(edges, hits, feature).select("event_id", F.col("nbr_id").alias("hit_id"), (weight * F.col(feature)).alias("pushed"))
    # Each row is there with nothing, so that no join has to bring back those that get nothing.
    all_rows = hits.select(*KEY, F.lit(0.0).alias("pushed")).unionByName(sent)
    return all_rows.groupBy(*KEY).agg(F.sum("pushed").alias("pushed"))


def softmax(edges: DataFrame, score: Column) -> DataFrame:
    w = Window.partitionBy(*KEY)
    e = edges.withColumn("_s", score)
    e = e.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    return e.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_s", "_e")


def softmax_sum(near: Column, value: Callable[[Column], Column], scale: float) -> Column:
    """Of a list by distance (knn.lists), the sum of value of its entries by the softmax of -dsq / scale."""
    part = _part(near, scale)
    return F.aggregate(near, F.lit(0.0), lambda s, n: s + part(n["dsq"]) * value(n)) / _parts(near, scale)


def softmax_edges(lists: DataFrame, scale: float, *keep: str) -> DataFrame:
    """exploded() lists by distance, with weight, the softmax of -dsq / scale over each row's edges."""
    near = F.col("near")
    edges = exploded(lists, *keep, near[0]["dsq"].alias("_nearest"), _parts(near, scale).alias("_parts"))
    return edges.withColumn("weight", F.exp(F.col("_nearest") / scale - F.col("dsq") / scale) / F.col("_parts")).drop("_nearest", "_parts")


def _part(near: Column, scale: float) -> Callable[[Column], Column]:
    return lambda dsq: F.exp(near[0]["dsq"] / scale - dsq / scale)


def _parts(near: Column, scale: float) -> Column:
    part = _part(near, scale)
    return F.aggregate(near, F.lit(0.0), lambda s, n: s + part(n["dsq"]))


def covariance(edges: DataFrame, hits: DataFrame, feature: str, coords: tuple[str, ...]) -> DataFrame:
    """Feature-weighted mean position and lower covariance triangle of each row's neighbours."""
    # Moments about the row's own place, by one aggregate: no edge is shuffled, and places far from 0 lose no digits.
    e = with_own(with_neighbour(edges, hits, feature, *coords), hits, *coords)
    w, off = F.col(f"n_{feature}"), {c: F.col(f"n_{c}") - F.col(c) for c in coords}
    parts = [(a, b) for i, a in enumerate(coords) for b in coords[: i + 1]]
    sums = [F.sum(w).alias("_w"), *(F.first(c).alias(f"_o_{c}") for c in coords), *((F.sum(w * F.col(f"n_{c}")) / (F.sum(w) + 1e-4)).alias(f"m_{c}") for c in coords)]
    sums += [F.sum(w * off[c]).alias(f"_s_{c}") for c in coords] + [F.sum(w * off[a] * off[b]).alias(f"_s_{a}{b}") for a, b in parts]
    rows = e.groupBy(*KEY).agg(*sums)
    m, s = {c: F.col(f"m_{c}") - F.col(f"_o_{c}") for c in coords}, {c: F.col(f"_s_{c}") for c in coords}
    cov = [((F.col(f"_s_{a}{b}") - m[b] * s[a] - m[a] * s[b] + m[a] * m[b] * F.col("_w")) / (F.col("_w") + 1e-4)).alias(f"cov_{a}{b}") for a, b in parts]
    return rows.select(*KEY, *cov, *(f"m_{c}" for c in coords))


def composed_covariance(edges: DataFrame, hits: DataFrame, strength: str, coords: Sequence[str], weight: Column) -> DataFrame:
    """All entries of each row's neighbour covariance, columns xx, xy, ...: each neighbour is taken about the mean of its own neighbours."""
    near = with_neighbour(edges, hits, strength, *coords).select(*KEY, "nbr_id", (weight * F.col(f"n_{strength}")).alias("_w"), *(F.col(f"n_{x}").cast("double").alias(f"n_{x}") for x in coords)).repartition("event_id")
    total = F.sum("_w") + 1e-3
    row, told = Window.partitionBy(*KEY), Window.partitionBy("event_id", "nbr_id")
    means = {f"_m{x}": F.sum(F.col("_w") * F.col(f"n_{x}")).over(row) / (F.sum("_w").over(row) + 1e-3) for x in coords}
    edge = near.withColumns(means | {"_tells": F.col("nbr_id") == F.min("nbr_id").over(row)})
    # One edge of each row also brings the row's mean to where the edges to that row are. Edges are made once and
    # shuffled once, by event; the windows and the sum find them there.
    seen = F.struct(F.lit(True).alias("_edge"), "nbr_id", *(F.lit(None).cast("double").alias(m) for m in means))
    mean = F.struct(F.lit(False).alias("_edge"), F.col("hit_id").alias("nbr_id"), *means)
    both = edge.select(*KEY, "_w", *(f"n_{x}" for x in coords), F.explode(F.when(F.col("_tells"), F.array(seen, mean)).otherwise(F.array(seen))).alias("_e"))
    both = both.select(*KEY, "_w", *(f"n_{x}" for x in coords), "_e.*")
    met = both.withColumns({m: F.max(m).over(told) for m in means} | {"_met": F.max(~F.col("_edge")).over(told)}).where("_edge and _met")
    off = {x: F.col(f"n_{x}") - F.col(f"_m{x}") for x in coords}
    return met.groupBy(*KEY).agg(*((F.sum(F.col("_w") * off[x] * off[y]) / total).alias(f"{x}{y}") for x in coords for y in coords))
