"""Ordered scans that never hold a whole key in one task.

Every key is cut into blocks that follow the sort order, and rows are dealt out by
``(key, block)`` once. All values of a chain are computed together inside the blocks; each
block leaves one summary, only summaries are ordered within a key, and what came before a
block is joined back to its rows. A key may so hold any share of the table, and a chain of
values along one order costs one exchange of its rows. Building a plan starts no job.

Values may use ``prev``, the row before. For the first row of a block that row is the last
one of the block before, so everything about first rows is settled on the summaries.

``block`` must never decrease along ``order``. Where no such expression splits a key well (no
keys at all, or many rows at one moment), leave it out: blocks are then ranges between
quantiles of the rows with the smallest hashes, found inside the plan. Blocks always follow
from the rows alone, so it does not matter how often Spark computes them. ``order`` must be
unique per key.

``WHOLE`` as the block says that keys are short lists: plain windows per key, without summaries
or a join, and without an exchange where the rows already lie by key. Rows beyond memory spill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"
BLOCKS_PER_PARTITION, ROWS_PER_BOUND = 2, 16
KINDS = ("sum", "max", "last", "since")
WHOLE = "whole"
Value = tuple[str, Column]
Block = Column | str | None


def _range_blocks(df: DataFrame, ranges: list[str]) -> DataFrame:
    """``df`` with its block: how many bounds are not above a row.

    The bounds come in one row of ``BLOCKS_PER_PARTITION`` entries for every shuffle
    partition, whatever the size of the table.
    """
    blocks = BLOCKS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*[F.col(c) for c in ranges])
    sample = df.select(row.alias("r"), F.xxhash64(*ranges).alias("h")).orderBy("h").limit(blocks * ROWS_PER_BOUND)
    found = sample.agg(F.array_sort(F.collect_list("r")).alias("__all"))
    step = F.greatest(F.size("__all") / F.lit(float(blocks)), F.lit(1.0))
    places = F.sequence(F.lit(1), F.least(F.size("__all"), F.lit(blocks)) - 1)
    picked = F.when(F.size("__all") > 1, F.transform(places, lambda i: F.get("__all", F.floor(i * step).cast("int"))))
    bounds = found.select(F.coalesce(picked, F.slice("__all", 1, 0)).alias("__bounds"))

    def reach(low: Column, stride: Column) -> Column:
        return low + F.when(F.get("__bounds", low + stride - 1) <= row, stride).otherwise(0)

    strides = F.array(*[F.lit(1 << i) for i in reversed(range(blocks.bit_length()))])
    block = F.aggregate(strides, F.lit(0), reach)
    return df.crossJoin(F.broadcast(bounds)).select(*df.columns, block.alias(BLOCK))


def _plus(kind: str, *parts: Column) -> Column:
    """Combine earlier to later parts, nulls standing for nothing."""
    if kind == "last":
        return F.coalesce(*reversed(parts))
    out = parts[0]
    for part in parts[1:]:
        out = F.coalesce(out + part, out, part) if kind == "sum" else F.greatest(out, part)
    return out


def _running(kind: str, value: Column, window) -> Column:
    merge = {"sum": F.sum, "max": F.max, "since": F.max, "last": lambda c: F.last(c, True)}[kind]
    return merge(value).over(window)


def fused(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Block = None,
    previous: Sequence[str] = (),
    name: str = "prev",
    uses: Sequence[str] | None = None,
    **values: Value,
) -> DataFrame:
    """Add ``name`` (a struct with the ``previous`` columns of the row before, null for the first
    of a key) and running values per key along ``order``.

    A value is ``(how, column)``. ``sum``, ``max`` and ``last`` (the latest that is not null) include
    the row, ``sum_before``, ``max_before`` and ``last_before`` do not; they are null while there
    was nothing. ``since`` counts the rows from the latest one where the column is true,
    that row included, or from the first of the key. Columns may use ``name``; they then
    read no other columns than ``uses`` (all by default).
    """
    keys, order, previous = list(keys), list(order), list(previous)
    if any(how.removesuffix("_before") not in KINDS or how == "since_before" for how, _ in values.values()):
        raise ValueError(f"kinds are {KINDS} or .._before")
    if isinstance(block, str):
        if block != WHOLE:
            raise ValueError("block is a column, None or WHOLE")
        return _whole(df, keys, order, previous, name, values)
    dealt = _range_blocks(df, [*keys, *order]) if block is None else df.withColumn(BLOCK, block)
    kb = [*keys, BLOCK]
    # a fixed number: the work per row is in the windows, so small inputs should not be packed together
    rows = dealt.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *kb)
    inside = Window.partitionBy(*kb).orderBy(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)

    counted = any(how == "since" for how, _ in values.values())
    rows = rows.withColumn("__rn", F.row_number().over(inside).cast("bigint")) if previous or counted else rows
    if previous:
        rows = rows.withColumn(name, F.lag(F.struct(*previous)).over(inside))
    first_row = F.col("__rn") == 1
    rows = rows.withColumns({f"__v_{n}": column for n, (_, column) in values.items()})
    # with a row before, the first row of a block is left to the summaries
    held = {n: F.when(~first_row, F.col(f"__v_{n}")) if previous else F.col(f"__v_{n}") for n in values}
    for n, (how, _) in values.items():
        if how == "since":
            held[n] = F.when(held[n], F.col("__rn"))
    kinds = {n: how.removesuffix("_before") for n, (how, _) in values.items()}
    carry = _carry(rows, keys, at, previous, name, df.columns if uses is None else uses, values, kinds, held)

    local = rows.withColumns(
        {f"__l_{n}": _running(kinds[n], held[n], upto if how == kinds[n] else before) for n, (how, _) in values.items()}
        | ({f"__w_{n}": F.first(f"__v_{n}").over(upto) for n in values} if previous else {})
    )
    joined = local.join(carry, kb, "left")
    out = [F.col(c) for c in df.columns]
    if previous:
        out.append(F.when(first_row, F.col("__p")).otherwise(F.col(name)).alias(name))
    for n, (how, _) in values.items():
        came, parts = F.col(f"__c_{n}"), [F.col(f"__l_{n}")]
        own = F.when(F.col("__later"), F.col(f"__f_{n}")).otherwise(F.col(f"__w_{n}")) if previous else None
        if kinds[n] == "since":
            begun = F.coalesce(own, F.lit(False)) if previous else F.lit(False)
            open_ = F.when(begun, F.col("__rn")).otherwise(F.col("__rn") + F.coalesce(came, F.lit(0)))
            total = F.when(parts[0].isNotNull(), F.col("__rn") - parts[0] + 1).otherwise(open_)
        elif previous:
            total = _plus(kinds[n], came, own, *parts)
            total = total if how == kinds[n] else F.when(first_row, came).otherwise(total)
        else:
            total = _plus(kinds[n], came, *parts)
        out.append(total.alias(n))
    return joined.select(*out)


def _whole(df: DataFrame, keys: list[str], order: list[str], previous: list[str], name: str, values: dict[str, Value]) -> DataFrame:
    """:func:`fused` by one window per key."""
    along = Window.partitionBy(*keys).orderBy(*order)
    upto, before = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    out = [F.col(c) for c in df.columns]
    rows = df
    if previous:
        rows = rows.withColumn(name, F.lag(F.struct(*previous)).over(along))
        out.append(F.col(name))
    rows = rows.withColumns({f"__v_{n}": column for n, (_, column) in values.items()})
    number = F.row_number().over(along).cast("bigint")
    for n, (how, _) in values.items():
        kind, held = how.removesuffix("_before"), F.col(f"__v_{n}")
        if kind == "since":
            rows = rows.withColumn("__rn", number) if "__rn" not in rows.columns else rows
            value = F.col("__rn") - F.coalesce(F.max(F.when(held, F.col("__rn"))).over(upto), F.lit(1)) + 1
        else:
            value = _running(kind, held, upto if how == kind else before)
        out.append(value.alias(n))
    return rows.select(*out)


def _carry(
    rows: DataFrame, keys: list[str], at: Column, previous: list[str], name: str, uses: Sequence[str],
    values: dict[str, Value], kinds: dict[str, str], held: dict[str, Column],
) -> DataFrame:
    """For every block but the first of a key: the row before it (``__p``), the values of its own
    first row (``__f_``) and what ran up to its start (``__c_``)."""
    totals = []
    for n, kind in kinds.items():
        if kind == "last":
            totals.append(F.max_by(held[n], F.when(held[n].isNotNull(), at)).alias(f"__t_{n}"))
        else:
            totals.append((F.sum if kind == "sum" else F.max)(held[n]).alias(f"__t_{n}"))
    if "since" in kinds.values():
        totals.append(F.max("__rn").alias("__rows"))
    if previous:
        totals.append(F.max_by(F.struct(*previous), at).alias("__t"))
        if values:
            totals.append(F.min_by(F.struct(*[c for c in uses if c not in keys]), at).alias("__e"))
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    blocks = rows.groupBy(*keys, BLOCK).agg(*totals, F.lit(True).alias("__is"))
    blocks = blocks.withColumn("__later", F.lag("__is").over(along))
    extra = []
    if previous:
        blocks = blocks.withColumn("__p", F.lag("__t").over(along))
        extra = ["__p"]
        if values:
            blocks = blocks.select("*", "__e.*", F.col("__p").alias(name))
            blocks = blocks.withColumns({f"__f_{n}": column for n, (_, column) in values.items()})
            extra += [f"__f_{n}" for n in values]
    for n, kind in kinds.items():
        total = F.col(f"__t_{n}")
        if kind == "since":
            begun = F.coalesce(F.col(f"__f_{n}"), F.lit(False)) if previous else F.lit(False)
            stands = (total.isNotNull() | begun).cast("int")
            left = F.when(total.isNotNull(), F.col("__rows") - total + 1).otherwise(F.col("__rows"))
            blocks = blocks.withColumns({f"__g_{n}": F.sum(stands).over(along), f"__m_{n}": left})
            part = Window.partitionBy(*keys, f"__g_{n}").orderBy(BLOCK)
            blocks = blocks.withColumn(f"__u_{n}", F.sum(f"__m_{n}").over(part))
            blocks = blocks.withColumn(f"__c_{n}", F.lag(f"__u_{n}").over(along))
        else:
            whole = _plus(kind, F.col(f"__f_{n}"), total) if previous else total
            earlier = along.rowsBetween(Window.unboundedPreceding, -1)
            blocks = blocks.withColumn(f"__c_{n}", _running(kind, whole, earlier))
    return blocks.where("__later").select(*keys, BLOCK, "__later", *extra, *[f"__c_{n}" for n in values])


def scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Block = None, *, inclusive: bool = False, **values: Value
) -> DataFrame:
    """Running ``sum``, ``max`` or ``last`` per key for every named value; exclusive by default."""
    end = "" if inclusive else "_before"
    return fused(df, keys, order, block, **{n: (how + end, column) for n, (how, column) in values.items()})


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Block = None, name: str = "number"
) -> DataFrame:
    """1-based dense numbering along ``order``."""
    return fused(df, keys, order, block, **{name: ("sum", F.lit(1).cast("bigint"))})


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None, columns: Sequence[str], name: str = "prev"
) -> DataFrame:
    """Add a struct ``name`` with ``columns`` of the preceding row, null for the first."""
    return fused(df, keys, order, block, columns, name)


def group_values(df: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    """Add aggregates of the whole group to every row.

    An aggregate (combined on the map side) joined back; adaptive execution splits the
    large side of a skewed key.
    """
    keys = list(keys)
    return df.join(df.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()]), keys)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key; ranks are limited before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def micros(column: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(column.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def hour_of(column: Column) -> Column:
    """Hour number, a block for time-ordered scans."""
    return F.floor(micros(column) / F.lit(3_600_000_000)).cast("bigint")


def position_block(column: str | Column = "position", size: int = 4096) -> Column:
    """Stretches of positions, the usual block of ordered lists."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c / F.lit(size)).cast("bigint")
