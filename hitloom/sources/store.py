"""A metrics store of Parquet tables that are partitioned by experiment."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hitloom.session import removed

NAME = "experiment_name"
#: Each append writes folders of its own under an experiment's, named after its batch.
BATCH = "batch_"


class MetricsStore:
    """Tables under one folder; each append adds rows, new columns may appear later."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def insert(self, table: str, rows: DataFrame, batch: str | None = None) -> None:
        """Appends rows; non-finite numbers are stored as 0. rows need the column experiment_name.

        A batch that is named is written once: the same name again replaces what it wrote for the same experiments.
        """
        for name, kind in rows.dtypes:
            if kind in ("double", "float"):
                x = F.col(f"`{name}`")
                rows = rows.withColumn(name, F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x).cast(kind))
        named = rows.withColumn(BATCH, F.lit(batch or uuid.uuid4().hex))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(NAME, BATCH).parquet(f"{self.folder}/{table}")

    def table(self, table: str) -> DataFrame:
        """All rows; experiments are strings, also where their names look like numbers."""
        path = f"{self.folder}/{table}"
        found = self.spark.read.option("mergeSchema", "true").parquet(path).schema
        plain = StructType([StructField(f.name, StringType()) if f.name in (NAME, BATCH) else f for f in found])
        return self.spark.read.schema(plain).parquet(path).drop(BATCH)

    def field_names(self, table: str) -> list[str]:
        return self.table(table).columns

    def get_data(self, table: str, experiments: str | Iterable[str] | None = None, fields: Iterable[str] | None = None, condition: str | None = None) -> DataFrame:
        """Rows of some experiments under an SQL condition; a missing table raises. Experiments prune folders."""
        rows = self.table(table)
        if experiments is not None:
            rows = rows.where(F.col(NAME).isin([experiments] if isinstance(experiments, str) else list(experiments)))
        if condition:
            rows = rows.where(F.expr(condition))
        return rows.select(*fields) if fields else rows

    def query(self, sql: str, **tables: str) -> DataFrame:
        """SQL in which {name} stands for a table of the store: query("SELECT ... FROM {rows}", rows="values")."""
        return self.spark.sql(sql, **{name: self.table(table) for name, table in tables.items()})

    def experiments(self, table: str) -> DataFrame:
        return self.table(table).select(NAME).distinct()

    def copy_experiment(self, table: str, experiment: str, to: "MetricsStore") -> None:
        to.insert(table, self.get_data(table, experiment))

    def delete_experiment(self, table: str, experiment: str) -> None:
        """Removes the experiment's folders of the table, found through its files: names may be escaped there."""
        jvm = self.spark.sparkContext._jvm
        files = self.get_data(table, experiment).select(F.input_file_name().alias("f")).distinct().collect()
        paths = {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r.f)).getParent().toString() for r in files}
        for path in paths:
            removed(self.spark, path)
        self.spark.catalog.refreshByPath(f"{self.folder}/{table}")
