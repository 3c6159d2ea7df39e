"""Contiguous shards of nearly equal bytes, cut out of one global prefix sum.

Rows are put in one global order by a range shuffle and written once. Each partition then gives
its totals (one small row a partition), whose running sums are the partitions' places in the whole;
a window inside each partition does the rest. No task sees more than one range of the order, and
a text that a third of the rows share is split by the second ordering column.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.shared import partitions, written


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16, group_slack: float = 0.1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs.

    The order is by text hash, then doc_id, so equal texts are neighbours. A row's shard is where
    its first byte lies between the equal targets. A group of equal texts that a target would cut
    stays whole, on the side of its middle, if it holds at most group_slack of a target; larger
    groups are cut, as else one of them could fill many shards.

    A null text counts as no bytes (size = overhead, CRC of the empty string) but is a group of its
    own beside the empty text; null doc_ids come first in a group. Repeated rows are placed one by
    one. An empty table gives no rows. Other columns of docs are ignored. With fewer rows than
    shards, or rows larger than a target, some shards are empty.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    ordered = written(
        rows.repartitionByRange(partitions(spark), "h", "text_crc32", "doc_id").withColumn("pid", F.spark_partition_id())
    )
    totals = sorted((r.pid, r.n, r.b) for r in ordered.groupBy("pid").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect())
    whole = sum(b for _, _, b in totals)
    starts_n = [0, *accumulate(n for _, n, _ in totals)]
    starts_b = [0, *accumulate(b for _, _, b in totals)]
    places = spark.createDataFrame(
        [(p, n, b) for (p, _, _), n, b in zip(totals, starts_n, starts_b)], "pid int, n0 long, b0 long"
    )
    w = Window.partitionBy("pid").orderBy("h", "text_crc32", "doc_id")
    placed = (
        ordered.withColumn("rn", F.row_number().over(w).cast("long") - 1)
        .withColumn("run", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(places), "pid")
        .select("doc_id", "size", "text_crc32", "h", (F.col("n0") + F.col("rn")).alias("at"), (F.col("b0") + F.col("run") - F.col("size")).alias("first"))
    )
    targets = [whole * k // shards for k in range(1, shards)]
    shard = sum(((F.col("first") >= t).cast("int") for t in targets), F.lit(0))
    placed = written(placed.withColumn("shard", shard))
    # Groups on both sides of a target: at most shards - 1, as groups are contiguous.
    cut = (
        placed.groupBy("h", "text_crc32")
        .agg(F.min("first").alias("lo"), F.max(F.col("first") + F.col("size")).alias("hi"), F.min("shard").alias("s0"), F.max("shard").alias("s1"))
        .where((F.col("s0") < F.col("s1")) & ((F.col("hi") - F.col("lo")) <= group_slack * whole / shards))
        .collect()
    )
    moved = [(r.h, r.text_crc32, bisect_right(targets, (r.lo + r.hi) // 2)) for r in cut]
    if moved:
        to = spark.createDataFrame(moved, "h long, text_crc32 long, to int")
        placed = placed.join(F.broadcast(to), ["h", "text_crc32"], "left").withColumn("shard", F.coalesce("to", "shard"))
    firsts = placed.groupBy("shard").agg(F.min("at").alias("at0"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("at") - F.col("at0")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
