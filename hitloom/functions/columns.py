"""Short names of columns: c.energy is the column energy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class _Columns:
    def __getattr__(self, name: str) -> Column:
        return F.col(name)


c = _Columns()
