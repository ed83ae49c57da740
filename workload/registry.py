"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def num(col: str | Column, name: str | None = None, digits: int | None = None) -> Column:
    """Column as double (exact decimals stay exact); with ``digits`` also rounded."""
    c = F.col(col) if isinstance(col, str) else col
    out = c.cast("double")
    if digits is not None:
        out = F.round(out, digits)
    return out.alias(name or col)


def nums(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Decimals to double; doubles rounded when ``digits`` is given; integers to bigint."""
    out = []
    for c, kind in df.dtypes:
        if kind.startswith("decimal"):
            out.append(num(c))
        elif kind in ("double", "float") and digits is not None:
            out.append(num(c, digits=digits))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(c).cast("long").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
