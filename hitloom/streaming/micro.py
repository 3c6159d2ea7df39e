"""Micro-batches: scoring of events as they come, and appends to a metrics store."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hitloom.session import exists, removed
from hitloom.sources.store import MetricsStore

Transform = Callable[[DataFrame], DataFrame]


def read_events(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def score(stream: DataFrame, transform: Transform, out: str, checkpoint: str) -> StreamingQuery:
    """Applies transform to all that is there, batch by batch, and appends the result; restarts go on where it ended.

    transform sees each batch as a table, so it may be any operator; rows of other batches are not in it (score_events).
    """
    return _written(stream, transform, out, checkpoint)


def whole_events(stream: DataFrame, rows: str) -> DataFrame:
    """The rows of events whose rows are all there; the column rows says how many an event has.

    Rows wait in the stream's state, by event, in whatever batches they come; the state of an event ends when it is complete.
    Rows without event_id or without a number in rows are left out.
    """
    schema = stream.schema

    def assemble(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pa.ipc.open_stream(state.get[0]).read_all()] if state.exists else []
        held += [pa.Table.from_pandas(part, preserve_index=False) for part in parts]
        table = pa.concat_tables(held, promote_options="permissive")
        if table.num_rows >= table[rows][0].as_py():
            state.remove()
            yield table.to_pandas()
        else:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))

    known = stream.where(f"event_id IS NOT NULL AND {rows} IS NOT NULL")
    return known.groupBy("event_id").applyInPandasWithState(assemble, schema, "held binary", "append", GroupStateTimeout.NoTimeout)


def score_events(stream: DataFrame, rows: str, transform: Transform, out: str, checkpoint: str) -> StreamingQuery:
    """As score(), on whole events only: neighbours, clusters and matches are those of a batch over the same rows."""
    return _written(whole_events(stream, rows), transform, out, checkpoint)


def _written(stream: DataFrame, transform: Transform, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch's result is a folder of its own below out, so a batch that runs again replaces its rows."""

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _source(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def append_metrics(stream: DataFrame, store: MetricsStore, table: str, summarise: Transform, checkpoint: str, flush_rows: int = 1) -> StreamingQuery:
    """Each batch's summary is one append to the store; a batch that runs again after a failure replaces its own rows.

    Batches are named after the checkpoint folder and their number: one folder serves one stream. Summaries wait below that
    folder until there are flush_rows of them, so that small batches make no small appends; flush() appends what is left.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = summarise(batch)
        if flush_rows <= 1:
            store.insert(table, rows, f"{_source(checkpoint)}-{number}")
            return
        spark, path = batch.sparkSession, f"{checkpoint}/waiting/{{}}"
        if exists(spark, path.format(number - 1)):
            rows = spark.read.schema(rows.schema).parquet(path.format(number - 1)).unionByName(rows)
        # What waited for this batch stays until the next one is done, as this one may run again.
        rows.write.mode("overwrite").parquet(path.format(number))
        rows = spark.read.schema(rows.schema).parquet(path.format(number))
        if rows.count() >= flush_rows:
            store.insert(table, rows, f"{_source(checkpoint)}-{number}")
            removed(spark, path.format(number))
        removed(spark, path.format(number - 2))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush(spark: SparkSession, store: MetricsStore, table: str, like: DataFrame, checkpoint: str, last: int) -> None:
    """Appends the summaries that still wait after the batch number last of an ended stream; like has their columns."""
    path = f"{checkpoint}/waiting/{last}"
    if exists(spark, path):
        store.insert(table, spark.read.schema(like.schema).parquet(path), f"{_source(checkpoint)}-{last}")
        removed(spark, path)
