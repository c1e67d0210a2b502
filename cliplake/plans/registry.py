"""Registration of queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplake.plans.views import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Flat comparable columns: times and nested values as text, doubles to six digits."""
    out = []
    for field in df.schema:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return plain(build(spark, sf))

        run.__name__ = build.__name__
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return build

    return register


TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def ts(column: str) -> str:
    """DuckDB text of a timestamp, as :func:`plain` writes it."""
    return TS.format(column)
