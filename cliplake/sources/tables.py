"""Reading the catalogue tables and checking what a writer would have enforced."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplake.schemas import ALLOWED, PARENTS, TABLES, UNIQUE_KEYS, schema


def read_catalogue(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All tables under ``root/<table>`` with their fixed schemas."""
    return {name: spark.read.schema(schema(name)).format(fmt).load(f"{root}/{name}") for name in TABLES}


def violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rule, table and number of offending keys or rows for the tables given."""
    checks: list[DataFrame] = []

    def report(df: DataFrame, table: str, rule: str) -> None:
        checks.append(
            df.agg(F.lit(table).alias("tbl"), F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("offending"))
        )

    for name, df in tables.items():
        for key in UNIQUE_KEYS.get(name, ()):
            if set(key) <= set(df.columns):
                counted = df.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
                report(counted.filter("n > 1"), name, f"unique {','.join(key)}")
        for (table, column), allowed in ALLOWED.items():
            if table == name and column in df.columns:
                bad = ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))
                report(df.filter(bad), name, f"allowed {column}")
        if "progress_percent" in df.columns:
            report(df.filter(~F.col("progress_percent").between(0, 100)), name, "range progress_percent")
    for (child, column), parent in PARENTS.items():
        if child in tables and parent in tables and column in tables[child].columns:
            ids = tables[parent].select(F.col("id").alias(column))
            report(tables[child].join(ids, column, "left_anti"), child, f"parent {column}")
    return reduce(lambda a, b: a.unionByName(b), checks)
