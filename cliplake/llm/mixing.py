"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document of a source should be taken ``rho = target / size of the source`` times.
The whole part is certain. The fractional parts are rounded together: two documents
transfer word mass, one up and one down, with the odds that keep both expectations, until
one of them is integral; the other goes on to the next pair. So a source's words keep
their sum exactly but for one last residual.

The pairs form a tree. Documents fall into groups of about ``GROUP`` by hash and are
folded there; each group leaves at most one fractional document, which meets the residuals
of ``GROUP`` neighbouring groups at the next level, and so on up to one per source. A hot
source has many groups, never a long one, and the depth is logarithmic. All draws are
hashes of the document and the level, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplake.llm.tables import stash, word_count

GROUP = 64
REPEATS = 1000  # repeats of one row that are dealt out together
_DONE = "array<struct<doc_id:bigint,size:bigint,up:boolean>>"
_UNIT = "struct<doc_id:bigint,size:bigint,weight:double,p:double,u:double>"


def source_targets(sources: DataFrame, max_copies: int = 3, cycle: int = 3) -> DataFrame:
    """Add ``target`` to a table ``(source, source_size)`` with a row per source.

    Sources in code point order, null last, weigh 1, 2, .., ``cycle``, repeating. All
    words are shared by weight; no target exceeds ``max_copies`` times its source, and
    what is cut off is shared again until none is above. The fixed point is a water
    level: sources fill up in the order of cap over weight.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("w", ((F.row_number().over(one) - 1) % cycle + 1).cast("double")).withColumn(
        "cap", F.col("source_size").cast("double") * max_copies
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    shared = weighed.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn(
        "level",  # if all earlier sources are full and this one and the later ones are not
        (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after),
    )
    open_ = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    level = F.max(open_).over(everything)  # that of the first open source; later ones come out lower
    return shared.withColumn("target", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap")))).select(
        "source", "source_size", "target"
    )


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _duel(state: Column, unit: Column) -> Column:
    """One transfer between the fractional document held in ``state`` and the next one."""
    held, done = state["held"], state["done"]
    room, mass = held["weight"] * (1 - held["p"]), held["weight"] * held["p"]
    other_room, other_mass = unit["weight"] * (1 - unit["p"]), unit["weight"] * unit["p"]
    up, down = F.least(room, other_mass), F.least(mass, other_room)
    rises = unit["u"] * (up + down) < down
    p = F.when(rises, F.when(room <= other_mass, 1.0).otherwise(held["p"] + up / held["weight"])).otherwise(
        F.when(mass <= other_room, 0.0).otherwise(held["p"] - down / held["weight"])
    )
    q = F.when(rises, F.when(other_mass <= room, 0.0).otherwise(unit["p"] - up / unit["weight"])).otherwise(
        F.when(other_room <= mass, 1.0).otherwise(unit["p"] + down / unit["weight"])
    )

    def with_p(x: Column, value: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["weight"].alias("weight"), value.alias("p"), x["u"].alias("u"))

    def decided(x: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), (x["p"] >= 1.0).alias("up"))

    def integral(x: Column) -> Column:
        return (x["p"] <= 0.0) | (x["p"] >= 1.0)

    pair = F.array(with_p(held, p), with_p(unit, q))
    return F.when(held.isNull(), F.struct(unit.cast(_UNIT).alias("held"), done.alias("done"))).otherwise(
        F.struct(
            F.get(F.filter(pair, lambda x: ~integral(x)), F.lit(0)).cast(_UNIT).alias("held"),
            F.concat(done, F.transform(F.filter(pair, integral), decided)).cast(_DONE).alias("done"),
        )
    )


def _fold(units: DataFrame, level: int) -> DataFrame:
    """``(source, bucket, held, done)``: each bucket folded to at most one fraction."""
    unit = F.struct(
        (-F.col("size")).alias("turn"),  # large documents first, so that a small one is left
        F.xxhash64("doc_id", F.lit(level)).alias("tie"),
        F.struct("doc_id", "size", "weight", "p", _uniform(F.lit(level), F.col("source"), F.col("doc_id"), F.col("size")).alias("u")).cast(_UNIT).alias("unit"),
    )
    start = F.struct(F.lit(None).cast(_UNIT).alias("held"), F.array().cast(_DONE).alias("done"))
    return (
        units.groupBy("source", "bucket")
        .agg(F.transform(F.array_sort(F.collect_list(unit)), lambda x: x["unit"]).alias("units"))
        .select("source", "bucket", F.aggregate("units", start, _duel).alias("s"))
        .select("source", "bucket", "s.held", "s.done")
    )


def _decided(sized: DataFrame, max_copies: int) -> DataFrame:
    """``(source, doc_id, size, repeats, source_size, target, whole, extra)`` of ``(doc_id,
    source, size, rows)``: each of a document's ``repeats`` is taken ``whole`` times, and
    ``extra`` of them once more."""
    units = stash(sized.groupBy("source", "doc_id", "size").agg(F.sum("rows").alias("repeats")))
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("source_size"), F.count("*").alias("n"))
    sources = stash(
        sources.join(
            source_targets(sources.select("source", "source_size"), max_copies).withColumnRenamed("source", "s").drop("source_size"),
            F.col("source").eqNullSafe(F.col("s")),
        ).drop("s")
    )
    rho = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.round(rho)
    shares = sources.withColumn("rho", F.when(F.abs(rho - near) < 1e-12, near).otherwise(rho)).select(
        F.col("source").alias("s"), "source_size", "target", "n", "rho", F.floor("rho").alias("whole")
    )
    # of the repeats a whole number takes one more; what is left is the fraction of one row
    share = F.col("repeats") * (F.col("rho") - F.col("whole"))
    share = F.when(F.abs(share - F.round(share)) < 1e-9, F.round(share)).otherwise(share)
    placed = stash(
        units.join(shares, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("share", share)
        .withColumn("certain", F.floor("share"))
        .withColumn("weight", F.col("size").cast("double"))
        .withColumn("p", F.col("share") - F.col("certain"))
        .drop("s", "rho", "share")
    )
    groups = F.ceil(F.col("n") / GROUP)
    level = 0
    left = placed.where("p > 0 and weight > 0").select(
        "source", F.pmod(F.xxhash64("doc_id", "size", F.lit("group")), groups).alias("bucket"), "doc_id", "size", "weight", "p"
    )
    most = (sources.agg(F.max("n")).first()[0] or 0) / GROUP
    decided = []
    while True:
        folded = stash(_fold(left, level))
        decided.append(folded.select("source", F.inline("done")))
        left = folded.where("held is not null").select(
            "source", F.floor(F.col("bucket") / GROUP).alias("bucket"), "held.doc_id", "held.size", "held.weight", "held.p"
        )
        if most <= 1:
            break
        most, level = most / GROUP, level + 1
    last = left.select("source", "doc_id", "size", (_uniform(F.lit("last"), F.col("source")) < F.col("p")).alias("up"))
    ups = last
    for part in decided:
        ups = ups.union(part)
    chosen = ups.where("up").select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("size").alias("z"), F.lit(1).alias("up"))
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z"))
    empty = (F.col("weight") == 0) & (_uniform(F.lit("empty"), F.col("source"), F.col("doc_id")) < F.col("p"))
    return stash(
        placed.join(chosen, same, "left").select(
            "source", "doc_id", "size", "repeats", "source_size", "target", F.col("whole").cast("bigint").alias("whole"),
            (F.col("certain") + F.when(F.col("up").isNotNull() | empty, 1).otherwise(0)).cast("bigint").alias("extra"),
        )
    )


def mix_sources(
    docs: DataFrame, max_copies: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)``, a row for each row of ``docs``.

    ``size`` counts words, 0 for null or empty texts; such rows move no words and are taken
    by an own draw. Null is a source of its own, the last. Rows that agree in id, source
    and size are repeats of one document (a null id is an id too): their copies differ by
    one at most and add up to the document's share, rounded to one row. Copies never exceed
    ``max_copies``. The words taken of a source miss its target by less than the size of
    one row. An empty table gives an empty result; other columns are not read.
    """
    sized = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), F.lit(1).cast("bigint").alias("rows"),
    )
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("repeats") - 1) / REPEATS)))
    end = F.least(F.col("repeats"), (F.col("block") + 1) * REPEATS) - 1
    return (
        _decided(sized, max_copies)
        .withColumn("block", block)
        .repartition("source", "doc_id", "size", "block")  # a document with many repeats is many blocks
        .withColumn("at", F.explode(F.sequence(F.col("block") * REPEATS, end)))
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (F.col("whole") + F.when(F.col("at") < F.col("extra"), 1).otherwise(0)).cast("bigint").alias("copies"),
        )
    )


def mixed_documents(docs: DataFrame, max_copies: int = 3) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the same columns.

    Rows equal in every column are interchangeable: one of them stands for the copies of
    all. Of repeats that differ in other columns those with smaller hashes come first, so
    reruns agree. Column names of ``docs`` cannot clash with those used here.
    """
    nulls = [F.col(f"`{c}`").isNull() for c in docs.columns]
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns], *nulls).alias("print"),
        F.struct("*").alias("row"),
    )
    groups = stash(rows.groupBy("doc_id", "source", "size", "print").agg(F.count("*").alias("rows")))
    plan = _decided(groups, max_copies).select(
        F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), "whole", "extra"
    )
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z"))
    earlier = Window.partitionBy("doc_id", "source", "size").orderBy("print").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("extra") - F.coalesce(F.sum("rows").over(earlier), F.lit(0))
    copies = F.col("rows") * F.col("whole") + F.greatest(F.lit(0), F.least(F.col("rows"), left))
    taken = (
        groups.join(plan, same)
        .withColumn("copies", copies.cast("bigint"))
        .where("copies > 0")
        .select(F.col("doc_id").alias("d"), F.col("print").alias("h"), "copies")
    )
    # equal rows are folded before the shuffle, so a row repeated often is one row a task
    once = rows.groupBy("doc_id", "print").agg(F.first("row").alias("row"))
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / REPEATS)))
    size = F.least(F.lit(REPEATS).cast("bigint"), F.col("copies") - F.col("block") * REPEATS)
    return (
        once.join(taken, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("h")))
        .withColumn("block", block)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
        .select("row.*")
    )
