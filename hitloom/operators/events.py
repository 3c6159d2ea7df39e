"""Whole events in one task each, streamed: memory holds one batch and one event."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_event(df: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str, *order: str, key: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """run on the rows of each event (or other key of integers), in the given order. Rows without event_id are left out.

    One shuffle brings events together; many small events share a task without a call to Python each.
    """

    def events(table: pa.Table) -> Iterator[pa.Table]:
        ids = np.stack([table[name].to_numpy() for name in key])
        edges = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), ids.shape[1]]
        for a, b in zip(edges, edges[1:]):
            yield table.slice(a, b - a)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            parts = list(events(new if rest is None else pa.concat_tables([rest, new]).combine_chunks()))
            rest = parts.pop()
            if parts:
                yield from pa.concat_tables([run(p) for p in parts]).combine_chunks().to_batches()
        if rest is not None:
            yield from run(rest).to_batches()

    return df.where("event_id is not null").repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(go, schema)


def large_events(df: DataFrame, rows: int) -> DataFrame | None:
    """event_id of the events of more than so many rows, or None if there are none: a job that counts by event_id."""
    large = df.groupBy("event_id").agg(F.count("*").alias("n")).where((F.col("n") > rows) & F.col("event_id").isNotNull()).select("event_id")
    return None if large.isEmpty() else large
