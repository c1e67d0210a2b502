"""Whole-catalogue snapshots: one JSON row per table row, and folders of them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cliplake.operators.state import conform, rewrite_paths, upsert
from cliplake.schemas import FORMAT_VERSION, IMPORT_ORDER, UNIQUE_KEYS, schema

# the default format would cut times to milliseconds
TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def snapshot_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(tbl, row) for all tables in dependency order, with every column of the layout; absent
    tables simply add nothing. Times keep their microseconds."""
    parts = [
        conform(tables[name], name).select(
            F.lit(name).alias("tbl"), F.to_json(F.struct("*"), {"ignoreNullFields": "false", **TIMES}).alias("row")
        )
        for name in IMPORT_ORDER
        if name in tables
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def table_from_rows(rows: DataFrame, table: str) -> DataFrame:
    parsed = F.from_json("row", schema(table), TIMES)
    return rows.filter(F.col("tbl") == table).select(parsed.alias("r")).select("r.*")


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table of the layout, in import order."""
    parts = [
        (
            tables[name].agg(F.count(F.lit(1)).alias("row_count"))
            if name in tables
            else next(iter(tables.values())).limit(0).agg(F.count(F.lit(1)).alias("row_count"))
        ).select(
            F.lit(i).alias("position"), F.lit(name).alias("tbl"), F.lit(FORMAT_VERSION).alias("format_version"), "row_count"
        )
        for i, name in enumerate(IMPORT_ORDER)
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def export_snapshot(
    spark: SparkSession, tables: Mapping[str, DataFrame], folder: str, exported_at: datetime | None = None
) -> dict[str, int]:
    """Write every table as JSON below a new folder, and the header last.

    A folder without its header is an export that never finished and cannot be
    imported, so readers see all of a snapshot or nothing. Rows are counted while
    they are written.
    """
    counts: dict[str, int] = {}
    for name in IMPORT_ORDER:
        df = conform(tables.get(name), name, spark)
        seen = Observation(f"rows_{name}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").options(**TIMES).json(
            f"{folder}/{name}"
        )
        counts[name] = int(seen.get["n"])
    when = (exported_at or datetime.now(timezone.utc)).isoformat()
    header = {"format_version": FORMAT_VERSION, "exported_at": when, "tables": counts}
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.mode("errorifexists").text(
        f"{folder}/header"
    )
    return counts


def read_header(spark: SparkSession, folder: str) -> dict:
    """The validated header of a snapshot; ValueError if it is not one this code can read."""
    text = spark.read.text(f"{folder}/header").first()
    try:
        header = json.loads(text[0]) if text else None
    except json.JSONDecodeError:
        header = None
    if not isinstance(header, dict):
        raise ValueError("snapshot header is not an object")
    if header.get("format_version") != FORMAT_VERSION:
        raise ValueError(f"unsupported format_version {header.get('format_version')!r}")
    if "tables" not in header:
        raise ValueError("snapshot header lists no tables")
    return header


def import_snapshot(
    spark: SparkSession,
    folder: str,
    current: Mapping[str, DataFrame],
    src: str | None = None,
    dst: str | None = None,
    replace: bool = False,
) -> dict[str, DataFrame]:
    """Current tables merged with a snapshot; ``inserted`` marks rows that came from it."""
    read_header(spark, folder)
    out = {}
    for name in IMPORT_ORDER:
        rows = spark.read.schema(schema(name)).options(**TIMES).json(f"{folder}/{name}")
        out[name] = merge_table(current.get(name), rows, name, src, dst, replace)
    return out


def merge_table(
    current: DataFrame | None, rows: DataFrame, table: str, src: str | None, dst: str | None, replace: bool
) -> DataFrame:
    if src and dst:
        rows = rewrite_paths(rows, table, src, dst)
    order = list(UNIQUE_KEYS[table][0])
    return upsert(conform(current, table, rows.sparkSession), rows, UNIQUE_KEYS[table], order, replace)


def inserted_counts(merged: Mapping[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.lit(name).alias("tbl"), F.count_if("inserted").alias("inserted"), F.count(F.lit(1)).alias("total"))
        for name, df in merged.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
