"""Shapes of events: angles, principal axes and outliers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.functions import scalar as S


def weighted_angle(hits: DataFrame, phi: str, weight: str) -> DataFrame:
    """event_id and the weighted mean of an angle, taken as differences from the heaviest row's angle."""
    w = Window.partitionBy("event_id").orderBy(F.desc(weight), "hit_id")
    rows = hits.withColumn("_top", F.first(phi).over(w))
    mean = F.sum(F.col(weight) * S.delta_phi(F.col(phi), F.col("_top"))) / F.sum(weight)
    sums = rows.groupBy("event_id").agg(F.max("_top").alias("_top"), mean.alias("_d"))
    return sums.select("event_id", S.delta_phi(F.col("_top") + F.col("_d"), F.lit(0.0)).alias(phi))


#: Rounds over all pairs of coordinates; the method converges quadratically.
SWEEPS = 6


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def principal_axes(covariance: Sequence[Sequence[Column]]) -> Column:
    """struct(values, vectors) of a symmetric matrix: its eigenvalues, and its eigenvectors as columns of a flat array.

    Jacobi rotations: each takes one pair of coordinates to where they do not vary together. All of it is one expression.
    """
    m = len(covariance)
    flat = F.array(*(covariance[max(i, j)][min(i, j)].cast("double") for i in range(m) for j in range(m)))
    one = F.array(*(F.lit(float(i == j)) for i in range(m) for j in range(m)))
    pairs = [F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(m) for q in range(p + 1, m)]
    steps = F.flatten(F.array_repeat(F.array(*pairs), SWEEPS)) if pairs else F.array().cast("array<struct<p:int,q:int>>")

    def turned(x: Column, r: Column, place: Callable[[Column], Column], stride: int) -> Column:
        """Columns (or rows) p and q of a flat matrix mixed with each other."""
        away = (r["q"] - r["p"]) * stride
        return F.transform(x, lambda v, i: F.when(place(i) == r["p"], r["c"] * v - r["s"] * F.get(x, i + away)).when(place(i) == r["q"], r["s"] * F.get(x, i - away) + r["c"] * v).otherwise(v))

    def step(held: Column, pair: Column) -> Column:
        a, p, q = held["a"], pair["p"], pair["q"]
        off, half = F.get(a, p * m + q), (F.get(a, q * m + q) - F.get(a, p * m + p)) / 2
        # The smaller of the two turns; none where nothing varies together.
        t = F.when(off == 0, 0.0).otherwise(off * F.when(half < 0, -1.0).otherwise(1.0) / (F.abs(half) + F.sqrt(half * half + off * off)))
        by = lambda t: F.struct(p.alias("p"), q.alias("q"), (1 / F.sqrt(1 + t * t)).alias("c"), (t / F.sqrt(1 + t * t)).alias("s"))
        column, row = (lambda i: i % m), (lambda i: F.floor(i / m))
        both = lambda r: F.struct(_let(turned(a, r, column, 1), lambda x: turned(x, r, row, m)).alias("a"), turned(held["v"], r, column, 1).alias("v"))
        return _let(_let(t, by), both)

    def result(held: Column) -> Column:
        return F.struct(F.array(*(F.get(held["a"], F.lit(i * m + i)) for i in range(m))).alias("values"), held["v"].alias("vectors"))

    return F.aggregate(steps, F.struct(flat.alias("a"), one.alias("v")), step, result)


def axis_ratio(hits: DataFrame, coords: Sequence[str], least: int) -> DataFrame:
    """ln((mean / least variance along principal axes - 1)^2 + 1) of events with enough rows; null where an axis has no spread.

    Only sums of products are shuffled.
    """
    names = [[f"k{i}{j}" for j in range(i + 1)] for i in range(len(coords))]
    sums = [F.covar_pop(coords[i], coords[j]).alias(names[i][j]) for i in range(len(coords)) for j in range(i + 1)]
    v = hits.groupBy("event_id").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)
    values = v.select("event_id", principal_axes([[F.col(c) for c in row] for row in names])["values"].alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / len(coords)
    q = F.try_divide(mean, F.array_min("v")) - 1
    return values.select("event_id", F.log(q * q + 1).alias("ratio"))


def outlier_scores(hits: DataFrame, features: Sequence[str], axes: int, least: int) -> DataFrame:
    """event_id, hit_id, score: distance in units of spread on the strongest principal axes of standardised features.

    Events with fewer rows than least give no rows; features and axes without spread do not count. Axes come from
    summed moments; rows meet their event's axes by a join.
    """
    m = len(features)
    names = [[f"k{i}{j}" for j in range(i + 1)] for i in range(m)]
    sums = [F.covar_pop(features[i], features[j]).alias(names[i][j]) for i in range(m) for j in range(i + 1)]
    v = hits.groupBy("event_id").agg(F.count("*").alias("n"), *sums, *(F.avg(f).alias(f"m{i}") for i, f in enumerate(features))).where(F.col("n") >= least)
    spread = [F.when(F.col(f"k{i}{i}") > 0, F.sqrt(f"k{i}{i}")).otherwise(1.0) for i in range(m)]
    v = v.withColumn("axes", principal_axes([[F.col(names[i][j]) / spread[i] / spread[j] for j in range(i + 1)] for i in range(m)]))
    order = F.slice(F.sort_array(F.transform(F.col("axes.values"), lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), 1, axes)
    v = v.select("event_id", *(f"m{i}" for i in range(m)), *(spread[i].alias(f"s{i}") for i in range(m)), order.alias("best"), F.col("axes.vectors").alias("vectors"))
    rows = hits.select("event_id", "hit_id", *features).join(v, "event_id")
    z = [(F.col(f) - F.col(f"m{i}")) / F.col(f"s{i}") for i, f in enumerate(features)]

    def part(total: Column, axis: Column) -> Column:
        along = sum((z[i] * F.get("vectors", F.lit(i * m) + axis["i"]) for i in range(1, m)), z[0] * F.get("vectors", axis["i"]))
        return total + F.when(-axis["x"] > 1e-12, along * along / -axis["x"]).otherwise(0.0)

    return rows.select("event_id", "hit_id", F.sqrt(F.aggregate("best", F.lit(0.0), part)).alias("score"))
