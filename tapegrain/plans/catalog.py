"""The list of registered queries: name -> (DataFrame builder, equivalent DuckDB text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = (fn, sql)
        return fn
    return keep


# Results are compared on a grid. Cell edges are shifted off the short decimals, so that numbers
# such as 12.34565 never sit on an edge where two engines could fall on different sides.
_SHIFT = 0.4637


def rnd(x, digits: int = 4) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x.cast("double") * float(10 ** digits) + _SHIFT) / float(10 ** digits)


def rs(expr: str, digits: int = 4) -> str:
    """The grid of ``rnd`` as DuckDB text."""
    return f"(floor(CAST({expr} AS DOUBLE) * {10 ** digits}::DOUBLE + {_SHIFT}::DOUBLE) / {10 ** digits}::DOUBLE)"


def day(x="session") -> Column:
    return F.date_format(x, "yyyy-MM-dd")


def ds(expr: str = "session") -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def stamp(x="ts") -> Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss")


def ts_sql(expr: str = "ts") -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"
