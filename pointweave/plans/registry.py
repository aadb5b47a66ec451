"""Query registry: name -> (Spark callable, SQL text), with one output contract for both sides.

A query states its output columns once, e.g. ``"recid:i uid:i b:f kind:s ok:b"``. Both sides are cast and
rounded by that contract: ``i`` bigint, ``f`` double rounded to 6 digits (``p``: 9, for small fractions) with
NaN/inf as NULL, ``s`` string, ``b`` boolean.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    item: str
    columns: list[tuple[str, str]]
    fn: QueryFn
    sql: str | None
    module: str


REGISTRY: dict[str, Query] = {}

_DIGITS = {"f": 6, "p": 9}
_SPARK = {"i": "bigint", "s": "string", "b": "boolean"}
_SQL = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}


def shape(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    out = []
    for name, kind in columns:
        if kind in _DIGITS:
            out.append(F.round(finite(name), _DIGITS[kind]).alias(name))
        else:
            out.append(F.col(name).cast(_SPARK[kind]).alias(name))
    return df.select(*out)


def shape_sql(body: str, columns: list[tuple[str, str]]) -> str:
    out = []
    for name, kind in columns:
        if kind in _DIGITS:
            x = f"CAST({name} AS DOUBLE)"
            out.append(f"CASE WHEN isfinite({x}) THEN round({x}, {_DIGITS[kind]}) + 0.0 END AS {name}")
        else:
            out.append(f"CAST({name} AS {_SQL[kind]}) AS {name}")
    return f"SELECT {', '.join(out)} FROM ({body}) AS q"


def query(name: str, item: str, columns: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    cols = [tuple(c.rsplit(":", 1)) for c in columns.split()]

    def register(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return shape(fn(spark, folder), cols)

        run.__name__ = name
        REGISTRY[name] = Query(name, item, cols, run, shape_sql(sql, cols) if sql else None, fn.__module__.rsplit(".", 1)[-1])
        return fn

    return register
