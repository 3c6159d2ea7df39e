"""Connected components of link tables by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.shared import written


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, label) for every node of links(a, b): the smallest node that it is linked with.

    known: labels of an earlier call, from which to go on. Labels spread to neighbours and jump to
    their label's label in every round, so rounds grow with the logarithm of a component's diameter.
    Nothing but the number of changes reaches the driver; each round is written to the shared folder.
    No links give no rows.
    """
    both = links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    if known is not None:
        both = both.unionByName(known.select(F.col("node").alias("a"), F.col("label").alias("b")))
        both = both.unionByName(known.select(F.col("label").alias("a"), F.col("node").alias("b")))
    both = written(both.distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        spread = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
            .join(labels, "node")
            .select("node", F.least("near", "label").alias("label"), F.col("label").alias("old"))
        )
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        step = written(spread.join(above, "label", "left").select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "old"))
        changed = step.where("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels
