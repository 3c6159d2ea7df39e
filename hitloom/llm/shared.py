"""Cutting lineage through tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hitloom.session import removed, shared_dir

#: Bytes of a batch that Python handles at once.
SLICE = 1 << 22
#: Bytes after which a row group of large rows ends. Parquet looks at sizes after 100 rows at first, which writers and readers would hold at once.
ROW_GROUP = 1 << 24
LARGE_ROWS = {"parquet.block.size": str(ROW_GROUP), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def written(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    A lost executor then costs a read of the table and not a rerun of what made it. An empty
    df comes back empty with the same columns. large_rows: rows of megabytes, whose row groups end at ROW_GROUP.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hitloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later step reads."""
    for table in tables:
        removed(table.sparkSession, table.written_path)


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """docs with columns c0, c1, ... whatever their names were, these names, and the old ones.

    Operators that keep all columns add their own beside c0, c1, ..., so none can clash.
    """
    old = docs.columns
    new = [f"c{i}" for i in range(len(old))]
    return docs.toDF(*new), new, old


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE bytes, so that Python copies of long texts stay small."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, on slices of batches; when a task ends, freed memory goes back to the machine.

    Spark uses Python workers again, and what one stage freed would else count beside the next stage's needs.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(sliced(batches))
        release()

    return task


def group_giving_back(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run for applyInArrow; freed memory goes back after groups of more than SLICE bytes."""

    @functools.wraps(run)
    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes > SLICE:
            release()
        return out

    return group


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
