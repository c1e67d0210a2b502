"""Catalogue maintenance: every operator maps current tables and changes to new tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplake.functions.labels import clock_label, file_stem
from cliplake.functions.specs import duration_spec, size_spec
from cliplake.operators.ordered import number_rows, position_block, scan, top_rows
from cliplake.operators.sequences import timeline
from cliplake.schemas import (
    ALLOWED,
    IMPORT_ORDER,
    JSON_PATH_COLUMNS,
    PARENTS,
    PATH_COLUMNS,
    schema,
)
from cliplake.session import cut_lineage

CLIPS_PER_DOCUMENT = 1000


def _max_id(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint")).alias("__max"))


def _with_new_ids(rows: DataFrame, current: DataFrame, order: Sequence[str]) -> DataFrame:
    """Ids after the largest one in use, in the given order.

    Range partitions along the order are numbered on their own; counts per partition give
    the offsets.
    """
    numbered = number_rows(rows, [], order, None, "__n")
    # one row, so the broadcast side has a fixed size
    return numbered.join(F.broadcast(_max_id(current)), F.lit(True)).select(
        *rows.columns, (F.col("__max") + F.col("__n")).alias("id")
    )


# ------------------------------------------------------------------ registration
def register_videos(videos: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ids for incoming files (original_path, creation_time): known paths keep theirs.

    A path that arrives twice counts once, with its earliest creation time.
    """
    once = incoming.groupBy("original_path").agg(F.min("creation_time").alias("creation_time"))
    known = videos.select("original_path", "id")
    fresh = once.join(known, "original_path", "left_anti")
    new = _with_new_ids(fresh, videos, ["creation_time", "original_path"])
    old = once.join(known, "original_path")
    return old.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))


def get_or_create_jobs(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For every wanted video its newest open job, else a new pending one."""
    videos = wanted.select("video_id").distinct()
    open_jobs = jobs.filter(F.col("status").isin("pending", "processing")).select(
        "video_id", "id", "status", "created_at"
    )
    newest = top_rows(open_jobs, ["video_id"], [F.desc("created_at"), F.desc("id")]).drop("created_at")
    found = videos.join(newest, "video_id").withColumn("created", F.lit(False))
    missing = videos.join(newest, "video_id", "left_anti")
    new = _with_new_ids(missing, jobs, ["video_id"]).select(
        "video_id", "id", F.lit("pending").alias("status"), F.lit(True).alias("created")
    )
    return found.unionByName(new)


# ------------------------------------------------------------------ job life cycle
def apply_job_events(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Fold events (job_id, seq, action, at, detail) into the jobs, last writer per column.

    Actions: the five statuses, ``finish`` (completed with 100 % and a result path),
    ``fail`` (failed with a message), ``progress`` (percent in ``detail``) and ``reset``
    (pending again, progress and times cleared). Others are ignored here; see
    :func:`illegal_events`.
    """
    a, at, detail = F.col("action"), F.col("at"), F.col("detail")
    statuses = ALLOWED[("transcoding_jobs", "status")]
    to_status = (
        F.when(a.isin(*statuses), a)
        .when(a == "finish", F.lit("completed"))
        .when(a == "fail", F.lit("failed"))
        .when(a == "reset", F.lit("pending"))
    )
    reset = a == "reset"
    percent = F.when(a == "finish", F.lit(100)).when(reset, F.lit(0)).otherwise(detail.try_cast("int"))
    rules: dict[str, tuple[Column, Column]] = {
        "status": (to_status.isNotNull(), to_status),
        "progress_percent": (a.isin("finish", "reset", "progress"), percent),
        "temp_file_path": (a == "finish", detail),
        "error_message": ((a == "fail") | reset, F.when(reset, F.lit(None)).otherwise(detail)),
        "started_at": ((a == "processing") | reset, F.when(reset, F.lit(None)).otherwise(at)),
        "completed_at": (
            a.isin("completed", "finish", "fail") | reset,
            F.when(reset, F.lit(None)).otherwise(at),
        ),
    }
    # an assigned null is wrapped in a struct, so that it differs from "not assigned"
    last = events.groupBy(F.col("job_id").alias("id")).agg(
        *[
            F.max_by(F.struct(value.alias("v")), F.when(touched, F.col("seq"))).alias(f"__{name}")
            for name, (touched, value) in rules.items()
        ]
    )
    joined = jobs.join(last, "id", "left")
    return joined.select(
        *[
            F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.v")).otherwise(F.col(c)).alias(c)
            if c in rules
            else F.col(c)
            for c in jobs.columns
        ]
    )


def illegal_events(events: DataFrame) -> DataFrame:
    legal = (*ALLOWED[("transcoding_jobs", "status")], "finish", "fail", "progress", "reset")
    return events.filter(~F.coalesce(F.col("action").isin(*legal), F.lit(False)))


def mark_merged(jobs: DataFrame, video_ids: DataFrame) -> DataFrame:
    """Completed jobs of the given videos become merged; ``changed`` tells which."""
    ids = video_ids.select("video_id").distinct().withColumn("__hit", F.lit(True))
    changed = F.coalesce(F.col("__hit"), F.lit(False)) & (F.col("status") == "completed")
    return (
        jobs.join(ids, "video_id", "left")
        .withColumn("changed", changed)
        .withColumn("status", F.when(F.col("changed"), F.lit("merged")).otherwise(F.col("status")))
        .drop("__hit")
    )


def reset_for_retry(jobs: DataFrame, which: Column) -> DataFrame:
    """Jobs that satisfy ``which`` start over."""
    cleared = {
        "status": F.lit("pending"),
        "progress_percent": F.lit(0),
        "error_message": F.lit(None),
        "started_at": F.lit(None),
        "completed_at": F.lit(None),
    }
    marked = jobs.withColumn("__hit", F.coalesce(which, F.lit(False)))
    return marked.select(
        *[
            F.when(F.col("__hit"), cleared[c]).otherwise(F.col(c)).cast(jobs.schema[c].dataType).alias(c)
            if c in cleared
            else F.col(c)
            for c in jobs.columns
        ]
    )


def resume_plan(videos: DataFrame, jobs: DataFrame, inventory: DataFrame) -> DataFrame:
    """What to do with each video: skip, redo, or mark its job merged and redo.

    ``inventory`` lists the result files that still exist (column ``path``).
    """
    done = jobs.filter((F.col("status") == "completed") & F.col("temp_file_path").isNotNull()).select(
        "video_id", F.col("id").alias("job_id"), "temp_file_path", "created_at", "id"
    )
    latest = top_rows(done, ["video_id"], [F.desc("created_at"), F.desc("id")])
    files = inventory.select(F.col("path").alias("temp_file_path")).distinct().withColumn("__there", F.lit(True))
    known = latest.join(files, "temp_file_path", "left").select("video_id", "job_id", "temp_file_path", "__there")
    action = (
        F.when(F.col("job_id").isNull(), F.lit("process"))
        .when(F.col("__there"), F.lit("skip"))
        .otherwise(F.lit("mark_merged_and_process"))
    )
    return (
        videos.select(F.col("id").alias("video_id"))
        .join(known, "video_id", "left")
        .select("video_id", "job_id", "temp_file_path", action.alias("action"))
    )


# ------------------------------------------------------------------ deletes
def cascade_delete(tables: Mapping[str, DataFrame], many: bool = False, **deleted: DataFrame) -> dict[str, DataFrame]:
    """Delete parent rows by id (``videos=ids`` ...) together with their child rows.

    With ``many`` the ids are a share of the table: they are dealt out with its rows and hashed, so
    that rows are neither sorted nor spilled. Few ids are best sent to all tasks, as Spark does.
    """
    out = dict(tables)
    for parent, ids in deleted.items():
        keys = ids.select(ids[ids.columns[0]].alias("id"))
        keys = keys.hint("shuffle_hash") if many else keys
        if parent in out:
            out[parent] = out[parent].join(keys, "id", "left_anti")
        for (child, column), owner in PARENTS.items():
            if owner == parent and child in out:
                out[child] = out[child].join(keys.withColumnRenamed("id", column), column, "left_anti")
    return out


def reset_build(tables: Mapping[str, DataFrame], paths: DataFrame, many: bool = False) -> dict[str, DataFrame]:
    """Forget the builds of some output paths.

    The newest merge of a path names the videos to delete (with their jobs); every
    merge of the path is deleted.
    """
    wanted = paths.select("output_path").distinct()
    hit = tables["merge_jobs"].join(wanted, "output_path", "left_semi")
    newest = top_rows(
        hit.select("output_path", "id", "created_at", "video_ids"),
        ["output_path"],
        [F.desc("created_at"), F.desc("id")],
    )
    videos = newest.select(F.explode(F.from_json("video_ids", "array<bigint>")).alias("id")).distinct()
    # the ids are stored, as several tables are compared with them
    return cascade_delete(tables, many, videos=cut_lineage(videos), merge_jobs=cut_lineage(hit.select("id")))


# ------------------------------------------------------------------ uploads
def _upload_order(uploads: DataFrame, value: str) -> Column:
    """Order of several uploads for one row: ``order_no`` where there is one, then the id."""
    number = F.col("order_no") if "order_no" in uploads.columns else F.lit(0)
    return F.struct(number.alias("n"), F.col(value).alias("v"))


def set_uploads(merges: DataFrame, uploads: DataFrame) -> DataFrame:
    """Store upload ids (merge_job_id, youtube_id[, order_no]); a null id clears, a set one completes.

    Several uploads for one merge are one change: the last id stays, and any id that was
    set has completed it.
    """
    order = _upload_order(uploads, "youtube_id")
    new = uploads.groupBy(F.col("merge_job_id").alias("id")).agg(
        F.max_by(F.struct("youtube_id"), order).alias("__new"), F.max(F.col("youtube_id").isNotNull()).alias("__set")
    )
    hit = F.col("__new").isNotNull()
    return (
        merges.join(new, "id", "left")
        .withColumn("status", F.when(hit & F.col("__set"), F.lit("completed")).otherwise(F.col("status")))
        .withColumn("youtube_id", F.when(hit, F.col("__new.youtube_id")).otherwise(F.col("youtube_id")))
        .select(*merges.columns)
    )


def append_split_uploads(splits: DataFrame, uploads: DataFrame) -> DataFrame:
    """Append upload ids (split_id, youtube_id[, order_no]) to a part's list; bad lists start anew.

    Several uploads for one part are appended together, in order.
    """
    order = _upload_order(uploads, "youtube_id")
    new = uploads.filter("youtube_id IS NOT NULL").groupBy(F.col("split_id").alias("id")).agg(
        F.array_sort(F.collect_list(order)).alias("__new")
    )
    listed = F.coalesce(F.from_json("youtube_ids", "array<string>"), F.array().cast("array<string>"))
    return (
        splits.join(new, "id", "left")
        .withColumn(
            "youtube_ids",
            F.when(
                F.col("__new").isNotNull(), F.to_json(F.concat(listed, F.transform("__new", lambda x: x["v"])))
            ).otherwise(F.col("youtube_ids")),
        )
        .select(*splits.columns)
    )


# ------------------------------------------------------------------ import
def rewrite_paths(df: DataFrame, table: str, src: str, dst: str, prefix_only: bool = False) -> DataFrame:
    """Replace ``src`` by ``dst`` in the table's path columns, item by item inside lists.

    Every occurrence is replaced unless ``prefix_only``; text that is not a list stays.
    """

    def swap(c: Column) -> Column:
        if prefix_only:
            return F.when(c.startswith(src), F.concat(F.lit(dst), c.substr(F.lit(len(src) + 1), F.length(c)))).otherwise(c)
        return F.replace(c, F.lit(src), F.lit(dst))

    changes = {}
    for name in PATH_COLUMNS.get(table, ()):
        if name not in df.columns:
            continue
        if name in JSON_PATH_COLUMNS:
            items = F.from_json(name, "array<string>")
            changes[name] = F.coalesce(F.to_json(F.transform(items, swap)), F.col(name))
        else:
            changes[name] = swap(F.col(name))
    return df.withColumns(changes) if changes else df


def _earlier_claim(rows: DataFrame, key: Sequence[str], pick, name: str) -> DataFrame:
    """Add the first (or last) order number that claims the row's key; null keys are free."""
    claims = rows.dropna(subset=list(key)).groupBy(*key).agg(pick("__order").alias(name))
    return rows.join(claims, list(key), "left")


def upsert(
    current: DataFrame,
    incoming: DataFrame,
    unique: Sequence[Sequence[str]],
    order: Sequence[str],
    replace: bool = False,
) -> DataFrame:
    """Rows after inserting ``incoming`` one by one in ``order``; ``inserted`` marks new ones.

    Without ``replace`` a row that conflicts with a stored one on any unique key is
    dropped; with it every stored row in conflict is dropped. Both follow from order
    numbers per key. Replacing needs one pass: a row stays if nothing later claims one
    of its keys. Ignoring repeats while rows wait for an earlier undecided one, which
    only happens when incoming rows conflict with each other on different keys.
    """
    first = unique[0]
    numbered = incoming.withColumn("__order", F.struct(F.lit(1).alias("new"), *order))
    if replace:
        stored = current.withColumn(
            "__order",
            F.struct(F.lit(0).alias("new"), *[F.lit(None).cast(incoming.schema[c].dataType).alias(c) for c in order]),
        )
        rows = stored.withColumn("inserted", F.lit(False)).unionByName(
            numbered.select(*current.columns, "__order", F.lit(True).alias("inserted"))
        )
        for i, key in enumerate(unique):
            rows = _earlier_claim(rows, key, F.max, f"__last{i}")
        keep = reduce(
            lambda a, b: a & b,
            [F.col(f"__last{i}").isNull() | (F.col(f"__last{i}") == F.col("__order")) for i in range(len(unique))],
        )
        return rows.filter(keep).select(*current.columns, "inserted")
    waiting = numbered
    for key in unique:
        waiting = waiting.join(current.select(*key).dropna(), list(key), "left_anti")
    if len(unique) == 1:
        # the rows behind the first one of a key are all in conflict with it; null keys are free.
        # One window along the join's partitioning, so a row is dealt out once.
        free = F.when(~reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in first]), F.col("__order"))
        rank = F.rank().over(Window.partitionBy(*first, free).orderBy("__order"))
        accepted = waiting.withColumn("__rank", rank).filter("__rank = 1")
        return current.withColumn("inserted", F.lit(False)).unionByName(
            accepted.select(*current.columns, F.lit(True).alias("inserted"))
        )
    accepted = None
    while True:
        ranked = waiting
        for i, key in enumerate(unique):
            ranked = _earlier_claim(ranked, key, F.min, f"__first{i}")
        lead = reduce(
            lambda a, b: a & b,
            [F.col(f"__first{i}").isNull() | (F.col(f"__first{i}") == F.col("__order")) for i in range(len(unique))],
        )
        leaders = ranked.filter(lead).select(*waiting.columns)
        accepted = leaders if accepted is None else accepted.unionByName(leaders)
        behind = ranked.filter(~lead).select(*waiting.columns)
        for key in unique:
            behind = behind.join(leaders.select(*key).dropna(), list(key), "left_anti")
        if behind.isEmpty():
            break
        waiting, accepted = cut_lineage(behind), cut_lineage(accepted)
    return current.withColumn("inserted", F.lit(False)).unionByName(
        accepted.select(*current.columns, F.lit(True).alias("inserted"))
    )


def conform(df: DataFrame | None, table: str, spark=None) -> DataFrame:
    """Bring an older snapshot to the current layout: missing columns null, missing table empty."""
    want = schema(table)
    if df is None:
        return spark.createDataFrame([], want)
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in want
        ]
    )


# ------------------------------------------------------------------ projects
def link_merges(
    projects: DataFrame, links: DataFrame, merges: DataFrame, pairs: DataFrame, now: Column, unlink: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Add (or remove) project-merge pairs; returns (projects, links) with dates refreshed."""
    key = ["project_id", "merge_job_id"]
    wanted = pairs.select(*key).distinct()
    if unlink:
        new_links = links.join(wanted, key, "left_anti")
    else:
        fresh = wanted.join(links, key, "left_anti").withColumn("added_at", now)
        new_links = links.unionByName(fresh.withColumn("added_at", F.col("added_at").cast(links.schema["added_at"].dataType)))
    touched = pairs.select(F.col("project_id").alias("id")).distinct().withColumn("__hit", F.lit(True))
    dates = (
        new_links.join(merges.select(F.col("id").alias("merge_job_id"), "date"), "merge_job_id")
        .groupBy(F.col("project_id").alias("id"))
        .agg(F.min("date").alias("__lo"), F.max("date").alias("__hi"))
    )
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    refreshed = projects.join(touched, "id", "left").join(dates, "id", "left")
    values = {"date_range_start": F.col("__lo"), "date_range_end": F.col("__hi"), "updated_at": now}
    return (
        refreshed.select(
            *[
                F.when(hit, values[c]).otherwise(F.col(c)).cast(projects.schema[c].dataType).alias(c)
                if c in values
                else F.col(c)
                for c in projects.columns
            ]
        ),
        new_links,
    )


def update_projects(projects: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Set descriptions and playlists (id, description, playlist_id[, order_no]).

    A null leaves the stored value. Several changes of one project are one: of each field
    the last value that is set. A project that is changed gets a new date.
    """
    number = F.col("order_no") if "order_no" in changes.columns else F.lit(0)
    fields = ("description", "playlist_id")
    # values break ties, so that the result does not depend on the order of rows
    last = changes.groupBy("id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(number.alias("n"), F.col(f).alias("v")))).alias(f"__{f}") for f in fields]
    )
    hit = F.coalesce(*[F.col(f"__{f}") for f in fields]).isNotNull()
    kind = projects.schema["updated_at"].dataType
    return (
        projects.join(last, "id", "left")
        .withColumn("updated_at", F.when(hit, now.cast(kind)).otherwise(F.col("updated_at")))
        .withColumns({f: F.coalesce(f"__{f}", f) for f in fields})
        .select(*projects.columns)
    )


def get_or_create_projects(projects: DataFrame, names: DataFrame) -> DataFrame:
    wanted = names.select("name").distinct()
    known = wanted.join(projects.select("name", "id"), "name")
    fresh = wanted.join(projects.select("name"), "name", "left_anti")
    new = _with_new_ids(fresh, projects, ["name"])
    return known.withColumn("created", F.lit(False)).unionByName(new.withColumn("created", F.lit(True)))


# ------------------------------------------------------------------ archive and backup
def number_destinations(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Free names for moved files: ``a.mp4``, then ``a_1.mp4``, ``a_2.mp4`` and so on.

    ``requests`` (order_no, dest, name) are served in order; ``existing`` (dest, name) is
    taken. The i-th request for a name gets the i-th number not taken, found with one
    running count. Every round is stored, as its clashes and the result are read from it. Two different names can still meet (``a.mp4`` numbered, and a file
    really called ``a_1.mp4``): the earlier request keeps the name, the number counts
    as taken for the other, and its requests are served again until nothing clashes.
    """
    family = ["dest", "stem", "suffix"]

    def parts(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "stem": file_stem(F.col("name")),
                "suffix": F.regexp_extract("name", r"^.+(\.[^.]+)$", 1),
            }
        )

    named = parts(requests)
    names = parts(existing).select(*family)
    asked = number_rows(named, family, ["order_no"], position_block("order_no"), "n")
    asked = asked.withColumn("i", F.col("n") - 1).drop("n")
    numbered = names.select(
        "dest",
        F.regexp_extract("stem", r"^(.+)_([1-9]\d*)$", 1).alias("stem"),
        "suffix",
        F.regexp_extract("stem", r"^(.+)_([1-9]\d*)$", 2).try_cast("bigint").alias("slot"),
    ).filter("slot IS NOT NULL")
    taken = names.withColumn("slot", F.lit(0).cast("bigint")).unionByName(numbered)
    taken = taken.join(asked.select(*family).distinct(), family, "left_semi").distinct()
    while True:
        ranked = number_rows(taken, family, ["slot"], position_block("slot"), "j")
        marks = ranked.select(
            *family, (F.col("slot") - F.col("j") + 1).alias("at"), F.lit(0).alias("kind"), F.col("slot").alias("tie")
        ).unionByName(
            asked.select(
                *family, F.col("i").alias("at"), F.lit(1).alias("kind"), F.col("order_no").alias("tie"), "name"
            ),
            allowMissingColumns=True,
        )
        placed = scan(
            marks,
            family,
            ["at", "kind", "tie"],
            position_block("at"),
            skipped=("sum", (F.col("kind") == 0).cast("bigint")),
        ).filter("kind = 1")
        slot = F.col("at") + F.coalesce("skipped", F.lit(0).cast("bigint"))
        final_name = F.when(slot == 0, F.col("name")).otherwise(F.concat("stem", F.lit("_"), slot, "suffix"))
        final = placed.select(*family, F.col("tie").alias("order_no"), "name", slot.alias("slot"), final_name.alias("final_name"))
        final = cut_lineage(final)
        clashes = (
            final.groupBy("dest", "final_name")
            .agg(F.min("order_no").alias("winner"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1")
        )
        lost = (
            final.join(clashes, ["dest", "final_name"])
            .filter("order_no > winner")
            .select(*family, "slot")
            .distinct()
        )
        if lost.isEmpty():
            return final.select("order_no", "dest", "name", "final_name")
        taken = cut_lineage(taken.unionByName(lost).distinct())


def archive_files(files: DataFrame, policy: str, existing: DataFrame | None = None) -> DataFrame:
    """Outcome per file (order_no, video_id, original_path, dest, name, present) under a policy.

    Outcomes are kept, moved, deleted, failed (a move without its source) and absent (a
    delete without its source). Moving files on disk is not part of this.
    """
    if policy == "keep":
        return files.select("video_id", "original_path", F.lit("kept").alias("outcome"), F.lit(None).cast("string").alias("destination_path"))
    if policy == "delete":
        return files.select(
            "video_id",
            "original_path",
            F.when(F.col("present"), "deleted").otherwise("absent").alias("outcome"),
            F.lit(None).cast("string").alias("destination_path"),
        )
    if policy != "move" or existing is None:
        raise ValueError("policy must be keep, delete, or move with the existing names")
    targets = number_destinations(files.filter("present").select("order_no", "dest", "name"), existing)
    named = files.join(targets.select("order_no", "final_name"), "order_no", "left")
    return named.select(
        "video_id",
        "original_path",
        F.when(F.col("present"), "moved").otherwise("failed").alias("outcome"),
        F.when(F.col("present"), F.concat("dest", F.lit("/"), "final_name")).alias("destination_path"),
    )


def archive_history_rows(outcomes: DataFrame, now: Column) -> DataFrame:
    return outcomes.filter(F.col("outcome").isin("moved", "deleted")).select(
        "video_id",
        F.when(F.col("outcome") == "moved", "move").otherwise("delete").alias("operation"),
        "original_path",
        "destination_path",
        now.alias("archived_at"),
    )


def backup_targets(
    outputs: DataFrame, splits: DataFrame, timelapses: DataFrame, inventory: DataFrame, originals: DataFrame | None = None
) -> DataFrame:
    """Files (merge_job_id, path) to back up, tagged by kind; ``present`` is false for missing ones."""
    tagged = [(outputs, "output"), (splits, "split"), (timelapses, "timelapse"), (originals, "original")]
    parts = [
        df.select("merge_job_id", F.col("path").alias("source_path"), F.lit(kind).alias("source_type"))
        for df, kind in tagged
        if df is not None
    ]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    files = inventory.select(F.col("path").alias("source_path")).distinct().withColumn("__there", F.lit(True))
    return every.join(files, "source_path", "left").select(
        "merge_job_id", "source_path", "source_type", F.coalesce("__there", F.lit(False)).alias("present")
    )


def append_backups(history: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Backup results (merge_job_id, source_path, remote, source_type, success, error_message) as new rows."""
    rows = _with_new_ids(results, history, ["merge_job_id", "source_type", "source_path"])
    return history.unionByName(
        rows.withColumn("backed_up_at", now.cast(history.schema["backed_up_at"].dataType)).select(*history.columns)
    )


# ------------------------------------------------------------------ merges
def clip_item() -> Column:
    """What a stored merge keeps of a clip that is laid on its timeline."""
    return F.struct(
        "position",
        "video_id",
        F.struct("name", "duration", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "device", "shot_time").alias("clip"),
    )


def clip_lists(items: str) -> tuple[Column, Column]:
    """The JSON lists (``clips_info_json``, ``video_ids``) of an array of clips in order."""
    return (
        F.to_json(F.transform(items, lambda x: x["clip"]), {"ignoreNullFields": "false"}).alias("clips_info_json"),
        F.to_json(F.transform(items, lambda x: x["video_id"])).alias("video_ids"),
    )


def in_parts(values: Column, size: int) -> Column:
    """An array cut into arrays of at most ``size``; an empty one has no parts."""
    starts = F.filter(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(size)).cast("int")), lambda _: F.size(values) > 0)
    return F.transform(starts, lambda i: F.slice(values, i * size + 1, F.lit(size)))


def merge_records(
    clips: DataFrame, clips_per_row: int = CLIPS_PER_DOCUMENT, short: bool = False
) -> DataFrame:
    """Totals, timeline and video id JSON per merge from its clips (merge_id, position, video_id, ...).

    The lists are a table of parts of ``clips_per_row`` clips, numbered from 0; every
    part carries the totals of the whole merge. With ``short`` positions must be dense and
    the clips of a merge are gathered at once.
    """
    laid = timeline(clips, ["merge_id"], short=short)
    count, total = F.count(F.lit(1)).alias("clip_count"), F.sum("duration").alias("total_duration")
    if short:
        gathered = laid.groupBy("merge_id").agg(count, total, F.array_sort(F.collect_list(clip_item())).alias("items"))
        cut = in_parts(F.col("items"), clips_per_row)
        parts = gathered.select("merge_id", "clip_count", "total_duration", F.posexplode(cut).alias("part", "items"))
        return parts.select("merge_id", F.col("part").cast("bigint").alias("part"), "clip_count", "total_duration", *clip_lists("items"))
    part = F.floor((F.col("position") - 1) / clips_per_row).cast("bigint")
    packed = laid.groupBy("merge_id", part.alias("part")).agg(F.array_sort(F.collect_list(clip_item())).alias("items"))
    totals = clips.groupBy("merge_id").agg(count, total)
    return packed.join(totals, "merge_id").select("merge_id", "part", "clip_count", "total_duration", *clip_lists("items"))


def split_plan(merges: DataFrame) -> DataFrame:
    """Nominal parts of merges (id, total_s, bitrate, duration_spec, size_spec).

    A duration rules over a size; a size needs a bitrate. One row per part, or one row
    with a reason.
    """
    merges = merges.select(
        "id",
        "total_s",
        "bitrate",
        duration_spec(F.col("duration_spec")).alias("by_time"),
        size_spec(F.col("size_spec")).alias("size"),
    )
    by_time, size = F.col("by_time"), F.col("size")
    by_size = F.when(F.col("bitrate") > 0, F.floor(size * 8 / F.col("bitrate")).cast("bigint"))
    seconds = F.coalesce(by_time, by_size)
    reason = (
        F.when(by_time.isNull() & size.isNull(), F.lit("no split criterion"))
        .when(by_time.isNull() & (F.coalesce(F.col("bitrate"), F.lit(0)) <= 0), F.lit("bitrate unknown"))
        .when(seconds <= 0, F.lit("segment shorter than a second"))
        .when(~F.coalesce(F.col("total_s") > 0, F.lit(False)), F.lit("length unknown"))
    )
    planned = merges.select("id", "total_s", seconds.alias("seconds"), reason.alias("reason"))
    parts = F.ceil(F.col("total_s") / F.col("seconds")).cast("bigint")
    numbers = F.when(F.col("reason").isNull(), F.sequence(F.lit(1).cast("bigint"), parts))
    out = planned.select("id", "total_s", "seconds", "reason", F.explode_outer(numbers).alias("part_no"))
    start = (F.col("part_no") - 1) * F.col("seconds")
    return out.select(
        "id",
        "part_no",
        "seconds",
        start.cast("double").alias("start_s"),
        F.least(start + F.col("seconds"), F.col("total_s")).alias("end_s"),
        "reason",
    )
