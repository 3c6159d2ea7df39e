"""Registry of queries and of the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.sources.tables import HITS, Tables, edges_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Neighbours, self included, of the edge table that most queries use.
K = 5


def query(sql: str | None = None):
    """Registers a function of Tables under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = rounded(sql)
        return f

    return add


def on_hits(body: str, *more: str) -> str:
    return "WITH " + ", ".join([HITS, *more]) + " " + body


def on_edges(body: str, *more: str) -> str:
    return on_hits(body, edges_sql(K), *more)


#: A little over one half: a tie goes up even if the order of a sum took its last bits away.
HALF = 0.5001


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounds half up through floor: the same operations on doubles as in the SQL, so ties fall alike."""
    scale = float(10**digits)
    return F.floor((F.col(c) if isinstance(c, str) else c) * scale + HALF) / scale


def rounded(sql: str) -> str:
    """The SQL with every round(x, n) written out as r() does it."""
    at = sql.find("round(")
    if at < 0:
        return sql
    depth, comma, i = 0, -1, at + 6
    while depth >= 0:
        ch = sql[i]
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            comma = i
        i += 1
    digits = int(sql[comma + 1 : i - 1])
    inner, scale = rounded(sql[at + 6 : comma]), f"1e{digits}"
    return f"{sql[:at]}(floor(({inner})*{scale}+{HALF})/{scale})" + rounded(sql[i:])
