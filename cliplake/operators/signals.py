"""Signal jobs on sample rows (keys..., idx, sample).

``keys`` name the columns that identify one recording or reference clip.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplake.operators.ordered import scan

# Detector and matcher settings.
FLOOR_MINIMUM = 1e-6
THRESHOLD_RATIO = 8.0
MIN_GAP_SECONDS = 0.25
PEAK_WINDOW_MS = 20.0
FRAME_SECONDS = 0.1
FLAT_DEVIATION = 1e-9
MIN_CONFIDENCE = 0.35
TEMPO_RANGE = (0.5, 2.0)

FRAMES_PER_CHUNK = 1024
LOUD_BLOCK = 1 << 18  # samples of a recording that one task looks at together


def _block(c: str, size: int) -> Column:
    return F.floor(F.col(c) / F.lit(size)).cast("bigint")


# ------------------------------------------------------------------ peaks
def noise_floor(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact median magnitude per key, not below 1e-6, and the peak threshold.

    Equal magnitudes are counted together before any shuffle. Counts per band of
    magnitude (a 32nd of an octave, so a key has a few thousand bands at most) tell in
    which band the middle ranks lie; only the values of that band are ordered.
    """
    keys = list(keys)
    values = samples.groupBy(*keys, F.abs("sample").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    band = F.floor(F.log2(F.greatest(F.col("m").cast("double"), F.lit(1e-30))) * 32).cast("bigint")
    values = values.withColumn("band", band)
    bands = values.groupBy(*keys, "band").agg(F.sum("c").alias("c"))
    before = Window.partitionBy(*keys).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    ranked = bands.withColumns(
        {"low": F.coalesce(F.sum("c").over(before), F.lit(0)), "n": F.sum("c").over(Window.partitionBy(*keys))}
    )
    first, second = "(n + 1) div 2", "n div 2 + 1"
    middle = ranked.filter(f"({first} > low AND {first} <= low + c) OR ({second} > low AND {second} <= low + c)")
    inside = Window.partitionBy(*keys, "band").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.join(middle.select(*keys, "band", "low", "n"), [*keys, "band"]).withColumn(
        "low", F.col("low") + F.coalesce(F.sum("c").over(inside), F.lit(0))
    )
    at = lambda rank: F.max(F.when(F.expr(f"{rank} > low AND {rank} <= low + c"), F.col("m")))
    floors = placed.groupBy(*keys).agg(((at(first) + at(second)) / 2).alias("m"))
    floor = F.greatest(F.col("m"), F.lit(FLOOR_MINIMUM))
    return floors.select(
        *keys, floor.alias("noise_floor"), (floor * THRESHOLD_RATIO).alias("threshold")
    )


def _window_peaks(idx: np.ndarray, m: np.ndarray, window: int) -> np.ndarray:
    """For every sample the place of the first maximum among those less than ``window`` after it.

    Maxima of stretches of 1, 2, 4, .. samples are built one from the other; the two longest
    that fit into a window cover it.
    """
    n = len(idx)
    ends = np.searchsorted(idx, idx + window)
    best, at = np.arange(n), np.arange(n)
    out, length = at.copy(), 1
    spans = ends - at
    while True:
        fits = (spans >= length) & (spans < 2 * length)
        head, tail = best[at[fits]], best[ends[fits] - length]
        out[fits] = np.where(m[tail] > m[head], tail, head)
        length *= 2
        if length > spans.max(initial=0):
            return out
        reach = n - length + 1
        first, second = best[:reach], best[length // 2 : length // 2 + reach]
        best = np.where(m[second] > m[first], second, first)


def _successors(idx: np.ndarray, m: np.ndarray, own: int, window: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Peak of each of the first ``own`` samples as a start, and the start after it (itself, if
    that one lies behind them)."""
    peaks = _window_peaks(idx, m, window)[:own]
    following = np.searchsorted(idx[:own], idx[peaks] + gap)
    return peaks, np.where(following < own, following, np.arange(own))


def _groups(pdf: pd.DataFrame, names: list[str]) -> np.ndarray:
    """Where the rows of a sorted frame change in ``names``, with both ends."""
    fresh = np.zeros(len(pdf), bool)
    for c in names:
        v = pdf[c]
        fresh |= (v != v.shift()).to_numpy() & ~(v.isna() & v.shift().isna()).to_numpy()
    fresh[:1] = True
    return np.append(np.flatnonzero(fresh), len(pdf))


def _whole_groups(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """Frames cut anew, so that none ends inside a group of ``names``."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if pdf.empty:
            continue
        cuts = _groups(pdf, names)
        same = bool(held) and len(_groups(pd.concat([held[-1].tail(1), pdf.head(1)]), names)) == 2
        if held and not same:
            yield pd.concat(held)
            held = []
        if len(cuts) == 2:
            held.append(pdf)
            continue
        split = cuts[1] if same else cuts[-2]
        if same:
            yield pd.concat([*held, pdf.iloc[:split]])
            held = []
            if cuts[-2] > split:
                yield pdf.iloc[split : cuts[-2]]
        elif split:
            yield pdf.iloc[:split]
        held = [pdf.iloc[cuts[-2] :]]
    if held:
        yield pd.concat(held)


def transient_peaks(
    samples: DataFrame,
    keys: Sequence[str],
    rate: int,
    threshold_ratio: float = THRESHOLD_RATIO,
    min_gap_seconds: float = MIN_GAP_SECONDS,
    window_ms: float = PEAK_WINDOW_MS,
    block: int = LOUD_BLOCK,
) -> DataFrame:
    """Peaks that stand out from the noise floor, at least a minimum gap apart.

    Every sample over the threshold could start a window; its peak tells the next start, so
    starts form chains. A recording is cut into blocks of ``block`` samples. A chain can enter a
    block only within a gap and a window from its beginning: pointer doubling tells for each
    of these entries where its chain leaves the block. These short tables are read once along
    the recording, which fixes the entry of every block, and the blocks then list their
    peaks. No task holds more than a block.
    """
    if rate <= 0:
        raise ValueError("rate must be positive")
    keys = list(keys)
    gap = max(1, int(rate * min_gap_seconds))
    window = max(1, int(rate * window_ms / 1000))
    if window > gap:
        raise ValueError("the peak window must not exceed the minimum gap")
    block = max(block, gap + window)
    floors = noise_floor(samples, keys).select(*keys, "noise_floor")
    m, at = F.abs("sample"), F.col("idx")
    number = F.floor(at / F.lit(block)).cast("bigint")
    # windows look into the next block, so its first samples are lent to the one before
    homes = F.when(at % block < window, F.array(number, number - 1)).otherwise(F.array(number))
    loud = (
        samples.join(floors, keys)
        .where(m >= F.col("noise_floor") * threshold_ratio)
        .select(*keys, F.explode(homes).alias("block"), "idx", m.cast("double").alias("m"), "noise_floor")
    )
    kb = [*keys, "block"]
    dealt = loud.repartition(*kb)
    key_fields = [samples.schema[k] for k in keys]
    table_type = T.StructType(
        [*key_fields, T.StructField("block", T.LongType()), T.StructField("bounds", T.ArrayType(T.LongType())), T.StructField("leaves", T.ArrayType(T.LongType()))]
    )
    entry_type = T.StructType([*key_fields, T.StructField("block", T.LongType()), T.StructField("entry", T.LongType())])
    out = T.StructType([*key_fields, T.StructField("idx", T.LongType()), T.StructField("score", T.DoubleType())])

    def one_block(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
        idx, values, number = pdf["idx"].to_numpy(np.int64), pdf["m"].to_numpy(np.float64), int(pdf["block"].iloc[0])
        return idx, values, number, int(np.searchsorted(idx, (number + 1) * block))

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(frames, kb):
            rows, cuts = [], _groups(pdf, kb)
            for a, b in zip(cuts, cuts[1:]):
                part = pdf.iloc[a:b]
                idx, values, number, own = one_block(part)
                if not own:
                    continue
                peaks, following = _successors(idx, values, own, window, gap)
                # pointer doubling up to the last start inside the block
                while True:
                    further = following[following]
                    if (further == following).all():
                        break
                    following = further
                leaves = idx[peaks[following]] + gap
                entries = min(own, int(np.searchsorted(idx, number * block + window + gap)) + 1)
                last = np.append(leaves[1:entries] != leaves[: entries - 1], True)  # of entries with one way out
                rows.append((*part[keys].iloc[0], number, idx[:entries][last], leaves[:entries][last]))
            yield pd.DataFrame(rows, columns=table_type.names)

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, at = None, 0
        for pdf in frames:
            rows = []
            for who, number, bounds, leaves in zip(zip(*[pdf[k].tolist() for k in keys]), pdf["block"], pdf["bounds"], pdf["leaves"]):
                if who != owner:
                    owner, at = who, np.iinfo(np.int64).min
                place = int(np.searchsorted(bounds, at))
                if place < len(bounds):
                    rows.append((*who, number, at))
                    at = int(leaves[place])
            yield pd.DataFrame(rows, columns=entry_type.names)

    def chains(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(frames, kb):
            found, cuts = [], _groups(pdf, kb)
            for a, b in zip(cuts, cuts[1:]):
                part = pdf.iloc[a:b]
                idx, values, _, own = one_block(part)
                first = int(np.searchsorted(idx[:own], int(part["entry"].iloc[0])))
                if first >= own:
                    continue
                peaks, following = _successors(idx, values, own, window, gap)
                reached, jump = np.array([first]), following
                while True:  # each doubling of the jump doubles the part of the chain that is known
                    more = np.unique(np.append(reached, jump[reached]))
                    if len(more) == len(reached):
                        break
                    reached, jump = more, jump[jump]
                top = peaks[reached]
                frame = part.iloc[top][keys].copy()
                frame["idx"], frame["score"] = idx[top], values[top] / part["noise_floor"].iloc[0]
                found.append(frame)
            if found:
                yield pd.concat(found)

    ordered = dealt.sortWithinPartitions(*kb, "idx")
    ways = ordered.mapInPandas(tables, table_type)
    known = ways.repartition(*keys).sortWithinPartitions(*kb).mapInPandas(entries, entry_type)
    lists = dealt.join(known, kb).sortWithinPartitions(*kb, "idx").mapInPandas(chains, out)
    return lists.withColumn("time_s", F.col("idx") / F.lit(float(rate)))


def clap_offset(peaks: DataFrame, keys: Sequence[str], role: str = "role") -> DataFrame:
    """Shift between the strongest reference peak and the strongest external one."""
    best = F.struct("time_s", "score")
    order = F.struct("score", -F.col("idx"))
    sides = peaks.groupBy(*keys).agg(
        F.max_by(F.when(F.col(role) == "reference", best), F.when(F.col(role) == "reference", order)).alias("r"),
        F.max_by(F.when(F.col(role) == "external", best), F.when(F.col(role) == "external", order)).alias("e"),
    )
    lost = F.col("r").isNull() | F.col("e").isNull()
    return sides.select(
        *keys,
        (F.col("r.time_s") - F.col("e.time_s")).alias("offset_s"),
        F.when(~lost, F.least(F.lit(1.0), F.least("r.score", "e.score") / 10.0)).alias("confidence"),
        F.when(lost, F.lit("no clear peak")).alias("reason"),
    )


def clap_drift(peaks: DataFrame, keys: Sequence[str], role: str = "role") -> DataFrame:
    """Shift and tempo ratio from the first and last peak of either side, with their peak counts."""
    point = F.struct("time_s", "score")
    aggs = [F.count_if(F.col(role) == side).alias(f"n_{side[0]}") for side in ("reference", "external")]
    for side in ("reference", "external"):
        at = F.when(F.col(role) == side, F.col("time_s"))
        value = F.when(F.col(role) == side, point)
        aggs += [F.min_by(value, at).alias(f"{side[0]}1"), F.max_by(value, at).alias(f"{side[0]}2")]
    s = peaks.groupBy(*keys).agg(*aggs)
    r_span = F.col("r2.time_s") - F.col("r1.time_s")
    e_span = F.col("e2.time_s") - F.col("e1.time_s")
    tempo = F.try_divide(e_span, r_span)
    reason = (
        F.when((F.col("n_r") < 2) | (F.col("n_e") < 2), F.lit("fewer than two peaks"))
        .when((r_span <= 0) | (e_span <= 0), F.lit("invalid span"))
        .when(~tempo.between(*TEMPO_RANGE), F.lit("tempo out of range"))
    )
    ok = reason.isNull()
    weakest = F.least("r1.score", "r2.score", "e1.score", "e2.score")
    return s.select(
        *keys,
        F.when(ok, F.col("r1.time_s") - F.col("e1.time_s")).alias("offset_s"),
        F.when(ok, tempo).alias("tempo_ratio"),
        F.when(ok, F.least(F.lit(1.0), weakest / 10.0)).alias("confidence"),
        reason.alias("reason"),
        F.col("n_r").alias("n_reference"),
        F.col("n_e").alias("n_external"),
    )


# ------------------------------------------------------------------ envelopes
def envelope(samples: DataFrame, keys: Sequence[str], rate: int) -> DataFrame:
    """Mean magnitude per frame of a tenth of a second (the last one may be short)."""
    if rate <= 0:
        raise ValueError("rate must be positive")
    size = max(1, int(rate * FRAME_SECONDS))
    frame = F.floor(F.col("idx") / size).cast("bigint")
    return samples.groupBy(*keys, frame.alias("frame")).agg(F.avg(F.abs("sample")).alias("energy"))


def normal_envelope(samples: DataFrame, keys: Sequence[str], rate: int) -> DataFrame:
    """Envelope with mean 0 and deviation 1; ``z`` is null where it is flat.

    Mean and deviation are combined per key and joined back, so the frames of a long
    recording stay spread over the cluster.
    """
    keys = list(keys)
    frames = envelope(samples, keys, rate)
    level = frames.groupBy(*keys).agg(
        F.avg("energy").alias("mean"), F.stddev_pop("energy").alias("sd"), F.count(F.lit(1)).alias("frames")
    )
    z = (F.col("energy") - F.col("mean")) / F.col("sd")
    return frames.join(level, keys).select(
        *keys, "frame", "energy", "frames", F.when(F.col("sd") > FLAT_DEVIATION, z).alias("z")
    )


def _chunks(frames: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Frames packed into rows of at most FRAMES_PER_CHUNK values."""
    packed = frames.groupBy(*keys, "frames", _block("frame", FRAMES_PER_CHUNK).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("frame", "z"))).alias("v")
    )
    return packed.select(
        *keys,
        F.col("frames").alias(f"{prefix}_frames"),
        F.col("chunk").alias(f"{prefix}_chunk"),
        F.transform("v", lambda x: x["z"]).alias(f"{prefix}_v"),
    )


def _padded(chunks: list, width: int) -> np.ndarray:
    out = np.zeros((len(chunks), width))
    for row, chunk in zip(out, chunks):
        row[: len(chunk)] = chunk
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _correlate(ext: pd.Series, ref: pd.Series) -> pd.Series:
    """Dot products of two chunks for every shift of one against the other, by Fourier transform.

    Padded to the sum of both lengths, the circular products are the plain ones.
    """
    out = []
    for a in range(0, len(ext), 256):
        es, rs = list(ext[a : a + 256]), list(ref[a : a + 256])
        width = 1 << (max(map(len, es)) + max(map(len, rs)) - 1).bit_length()
        spectrum = np.fft.rfft(_padded(es, width)) * np.conj(np.fft.rfft(_padded(rs, width)))
        for row, e, r in zip(np.fft.irfft(spectrum, width), es, rs):
            out.append(np.concatenate([row[width - len(r) + 1 :], row[: len(e)]]))
    return pd.Series(out)


def lag_correlation(
    reference: DataFrame, external: DataFrame, keys: Sequence[str], ref_keys: Sequence[str] = ()
) -> DataFrame:
    """Correlation of a reference envelope with a recording at every full overlap.

    Inputs are normal envelopes. ``keys`` pair a recording with its references, which
    ``ref_keys`` tell apart. Both sides are cut into chunks; every chunk is sent to the pairs that it
    belongs to, so that pairs of one session are dealt over all tasks, and each pair gives
    partial dot products that are summed per lag.
    """
    keys, ref_keys = list(keys), list(ref_keys)
    ref = _chunks(reference.filter("z IS NOT NULL"), [*keys, *ref_keys], "r")
    ext = _chunks(external.filter("z IS NOT NULL"), keys, "e")
    chunks = lambda frames: F.ceil(F.col(frames) / F.lit(FRAMES_PER_CHUNK)).cast("bigint")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    e_sizes = ext.groupBy(*keys).agg(F.max("e_frames").alias("e_frames"))
    r_sizes = ref.groupBy(*keys, *ref_keys, "r_frames").agg(F.lit(1).alias("one")).drop("one")
    fitting = r_sizes.join(e_sizes, keys).filter("e_frames >= r_frames AND r_frames >= 2")
    sent_ref = ref.drop("r_frames").join(fitting, [*keys, *ref_keys]).select("*", numbers(chunks("e_frames")).alias("e_chunk"))
    sent_ext = ext.drop("e_frames").join(fitting.select(*keys, *ref_keys, "r_frames"), keys).select(
        *keys, *ref_keys, "e_chunk", "e_v", numbers(chunks("r_frames")).alias("r_chunk")
    )
    pairs = sent_ref.join(sent_ext, [*keys, *ref_keys, "r_chunk", "e_chunk"])
    shift = (F.col("e_chunk") - F.col("r_chunk")) * FRAMES_PER_CHUNK - (F.size("r_v") - 1)
    parts = pairs.select(
        *keys,
        *ref_keys,
        "r_frames",
        "e_frames",
        shift.alias("shift"),
        F.posexplode(_correlate("e_v", "r_v")).alias("pos", "dot"),
    ).withColumn("lag", F.col("shift") + F.col("pos"))
    return (
        parts.filter("lag BETWEEN 0 AND e_frames - r_frames")
        .groupBy(*keys, *ref_keys, "r_frames", "e_frames", "lag")
        .agg((F.sum("dot") / F.col("r_frames")).alias("corr"))
    )


def audio_reasons(
    reference: DataFrame, external: DataFrame, keys: Sequence[str], ref_keys: Sequence[str] = ()
) -> DataFrame:
    """Every pair of a reference and its recording with the reason it can't be placed, or null.

    Inputs are normal envelopes; a reference without a recording is a pair too.
    """
    keys, ref_keys = list(keys), list(ref_keys)

    def sizes(frames: DataFrame, by: list[str], prefix: str) -> DataFrame:
        return frames.groupBy(*by).agg(F.max("frames").alias(f"{prefix}_n"), F.count("z").alias(f"{prefix}_z"))

    pairs = sizes(reference, [*keys, *ref_keys], "r").join(sizes(external, keys, "e"), keys, "left")
    reason = (
        F.when(F.col("e_n").isNull(), F.lit("no recording"))
        .when((F.col("r_n") < 2) | (F.col("e_n") < 2), F.lit("audio too short"))
        .when(F.col("e_n") < F.col("r_n"), F.lit("recording shorter than the clip"))
        .when((F.col("r_z") == 0) | (F.col("e_z") == 0), F.lit("envelope too flat"))
    )
    return pairs.select(*keys, *ref_keys, reason.alias("reason"))


def with_reasons(placed: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All pairs of :func:`audio_reasons`, with their placement where there is one."""
    own = pairs.withColumnRenamed("reason", "__why")
    return own.join(placed, list(keys), "left").withColumn("reason", F.coalesce("__why", "reason")).select(*placed.columns)


def confidence(corr: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (corr + 1.0) / 2.0))


def best_segment(
    correlations: DataFrame,
    keys: Sequence[str],
    search_start: float = 0.0,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Earliest best lag from the search start on, or the reason there is none."""
    start = F.least(
        F.lit(max(0, int(search_start / FRAME_SECONDS))).cast("bigint"), F.col("e_frames") - F.col("r_frames")
    )
    best = (
        correlations.withColumn("first", start)
        .filter("lag >= first")
        .groupBy(*keys)
        .agg(
            F.max_by(F.struct("lag", "corr"), F.struct("corr", -F.col("lag"))).alias("b"),
            F.min("first").alias("first"),
        )
    )
    found = F.col("b.corr") > -1.0
    lag = F.when(found, F.col("b.lag")).otherwise(F.col("first"))
    sure = confidence(F.when(found, F.col("b.corr")).otherwise(F.lit(-1.0)))
    low = sure < min_confidence
    return best.select(
        *keys,
        F.when(~low, lag * F.lit(FRAME_SECONDS)).alias("start_s"),
        sure.alias("confidence"),
        F.when(low, F.lit("confidence too low")).alias("reason"),
    )


def chained_segments(
    correlations: DataFrame,
    keys: Sequence[str],
    ref_key: str,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """References of a recording placed in order, each search starting where the last ended.

    A lag can only be chosen if no later lag of its reference correlates better. These
    few lags are found by a scan from the end; the chain over them runs in reference
    order while they stream through the task of their recording. A reference below the
    confidence limit ends the chain; the ones after it are reported as skipped.
    """
    keys = list(keys)
    rows = correlations.withColumn("from_end", F.col("e_frames") - F.col("lag"))
    later = scan(
        rows,
        [*keys, ref_key],
        ["from_end"],
        _block("from_end", FRAMES_PER_CHUNK),
        after=("max", F.col("corr")),
    )
    records = later.filter("after IS NULL OR corr >= after").select(
        *keys, ref_key, "lag", "corr", "r_frames", "e_frames"
    )
    ordered = records.repartition(*keys).sortWithinPartitions(*keys, ref_key, "lag")
    out = T.StructType(
        [
            *[correlations.schema[k] for k in (*keys, ref_key)],
            T.StructField("start_s", T.DoubleType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("reason", T.StringType()),
        ]
    )

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner = current = None
        begin, ended, placed = 0.0, False, False
        for pdf in batches:
            rows: list[tuple] = []
            who_cols = [pdf[k].tolist() for k in keys]
            for who, ref, lag, corr, r_n, e_n in zip(
                zip(*who_cols),
                pdf[ref_key].tolist(),
                pdf["lag"].tolist(),
                pdf["corr"].tolist(),
                pdf["r_frames"].tolist(),
                pdf["e_frames"].tolist(),
            ):
                if who != owner:
                    owner, current, begin, ended = who, None, 0.0, False
                if ref != current:
                    current, placed = ref, False
                if placed:
                    continue
                if ended:
                    rows.append((*who, ref, None, None, "skipped"))
                    placed = True
                    continue
                first = min(max(0, int(begin / FRAME_SECONDS)), e_n - r_n)
                if lag < first:
                    continue
                placed = True
                lag = lag if corr > -1.0 else first
                sure = max(0.0, min(1.0, (max(corr, -1.0) + 1.0) / 2.0))
                if sure < min_confidence:
                    ended = True
                    rows.append((*who, ref, None, sure, "confidence too low"))
                    continue
                begin = lag * FRAME_SECONDS + r_n * FRAME_SECONDS
                rows.append((*who, ref, lag * FRAME_SECONDS, sure, None))
            if rows:
                yield pd.DataFrame(rows, columns=out.names)

    return ordered.mapInPandas(chain, out)
