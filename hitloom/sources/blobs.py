"""Generated events: round blobs of hits and a little noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blobs an event, rows a blob (both ends included), rows of noise.
BLOBS, ROWS, NOISE = (2, 6), (1800, 1899), 10


def _uniform(seed: int, name: str, *keys: str) -> Column:
    """A number in (0, 1) that depends on seed, name and keys alone, so lost tasks come back alike, and SQL can follow."""
    digest = F.md5(F.concat_ws("-", F.lit(f"{seed}-{name}"), *keys).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def _between(u: Column, low: int, high: int) -> Column:
    return (low + F.floor(u * (high - low + 1))).cast("int")


def _normal(seed: int, name: str, *keys: str) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, f"{name} radius", *keys))) * F.cos(2 * math.pi * _uniform(seed, f"{name} angle", *keys))


def events(of: DataFrame, seed: int = 0) -> DataFrame:
    """An event for each row of of(event_id): event_id, hit_id, t_idx (-1: noise), energy, x, y, z.

    Blobs are dealt to tasks before their rows are made: a row of a small table stands for thousands, and its few files
    would be as many tasks. A number is named, as adaptive execution goes by the few bytes of the blobs.
    """
    spark = of.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    blob = of.select("event_id")
    blob = blob.withColumn("t_idx", F.explode(F.sequence(F.lit(-1), _between(_uniform(seed, "blobs", "event_id"), *BLOBS) - 1)))
    blob = blob.repartition(parts, "event_id", "t_idx")
    size = F.when(F.col("t_idx") < 0, F.lit(NOISE)).otherwise(_between(_uniform(seed, "rows", "event_id", "t_idx"), *ROWS))
    centre = {d: 20 * _uniform(seed, f"centre {d}", "event_id", "t_idx") - 10 for d in "xyz"}
    rows = blob.withColumns({f"_{d}": v for d, v in centre.items()}).withColumn("_k", F.explode(F.sequence(F.lit(1), size)))
    at = ("event_id", "t_idx", "_k")
    place = [F.when(F.col("t_idx") < 0, 20 * _uniform(seed, d, *at) - 10).otherwise(F.col(f"_{d}") + 0.5 * _normal(seed, d, *at)).alias(d) for d in "xyz"]
    number = ((F.col("t_idx") + 1) * (ROWS[1] + 1) + F.col("_k")).cast("long").alias("hit_id")
    return rows.select("event_id", number, "t_idx", _uniform(seed, "energy", *at).alias("energy"), *place)
