"""Values on the border of a rule: queries and SQL on small tables that were made for it."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from hitloom import catalog
from hitloom.sources import blobs

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query and of its SQL over hits (event, supplier, x, price)."""

    def run(name: str, hits: list[tuple]) -> tuple[list, list]:
        day = datetime.date(2020, 1, 1)
        rows = [(i, e, s, 1, x, price, 0.0, 0.0, "A", "O", day) for i, (e, s, x, price) in enumerate(hits)]
        spark.createDataFrame(rows, LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
        df = catalog.queries()[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
        want = con.sql(catalog.oracle_sql()[name])
        return sorted(map(tuple, df.select(*want.columns).collect()), key=str), sorted(want.fetchall(), key=str)

    return run


def test_overlap_on_the_border_of_two_bins(both):
    # 0.1 / (0.2 + 0.4 - 0.1) is one fifth, and 0.19999999999999996 in doubles.
    got, want = both("overlap_histogram", [(1, 1, 1.0, 100.0), (1, 1, 20.0, 100.0), (1, 2, 1.0, 300.0)])
    assert got == want == [(2, 1, 2.0), (5, 1, 5.0), (7, 1, 7.5)]


def test_object_without_any_weight(both):
    # Prices of whole thousands have beta 0: no weight to divide by.
    got, want = both("payload_weights_cut", [(1, 1, 1.0, 3000.0), (2, 1, 1.0, 500.0), (2, 1, 1.0, 4000.0)])
    assert got == want == [(1, 1, 0.0, None), (2, 1, 1.0, 1.0), (2, 2, 0.0, 0.0)]


def test_generated_rows_are_dealt_to_many_tasks(spark):
    of = spark.range(40).coalesce(1).withColumnRenamed("id", "event_id")
    assert blobs.events(of).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
