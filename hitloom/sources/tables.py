"""Point-cloud views over the star-schema tables, as DataFrames and as the SQL of their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HIT_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


class Tables:
    """The views of one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def hits(self) -> DataFrame:
        """Line items as hits: one event per part, numbered in a fixed order."""
        # Numbered by event_id itself, so that later steps by event need no shuffle of their own.
        w = Window.partitionBy("event_id").orderBy(*HIT_ORDER)
        return self.table("lineitem").withColumn("event_id", F.col("l_partkey")).select(
            "event_id",
            F.row_number().over(w).cast("long").alias("hit_id"),
            F.col("l_quantity").alias("x"),
            (F.col("l_extendedprice") / 2000).alias("y"),
            (F.col("l_discount") * 500).alias("z"),
            (F.col("l_extendedprice") / 1000).alias("energy"),
            ((F.col("l_extendedprice") % 1000) / 1000).alias("beta"),
            (F.col("l_suppkey") % 6 - 1).cast("int").alias("t_idx"),
            (F.col("l_linenumber") % 4 == 0).alias("is_track"),
            F.col("l_tax").alias("tax"),
            F.col("l_returnflag").alias("cls"),
        )


#: The hits view as a common table expression.
HITS = f"""hits AS (SELECT l_partkey AS event_id,
  row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(HIT_ORDER)}) AS hit_id,
  l_quantity AS x, l_extendedprice / 2000 AS y, l_discount * 500 AS z, l_extendedprice / 1000 AS energy,
  (l_extendedprice % 1000) / 1000 AS beta, CAST(l_suppkey % 6 - 1 AS INTEGER) AS t_idx,
  l_linenumber % 4 = 0 AS is_track, l_tax AS tax, l_returnflag AS cls FROM lineitem)"""

DSQ = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"


def edges_sql(k: int = 5, on: str = "a.event_id = b.event_id", name: str = "edges", dsq: str = DSQ) -> str:
    """k nearest neighbours with self in slot 0, as a common table expression after hits."""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, hit_id ORDER BY (nbr_id <> hit_id), dsq, nbr_id) - 1 AS slot
  FROM (SELECT a.event_id, a.hit_id, b.hit_id AS nbr_id, {dsq} AS dsq FROM hits a JOIN hits b ON {on})) WHERE slot < {k})"""
