"""Operators over ordered frames, segments and labels, keyed by meeting.

Everything that has a closed form is a window over the meeting's order; what depends on the last kept row
is a fold over the meeting's own array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def _order(key: str, order: str):
    return W.partitionBy(key).orderBy(order)


def percentile_threshold(frames: DataFrame, key: str, level: str, config: Config = DEFAULT) -> DataFrame:
    """key, floor, peak, threshold: the floor percentile plus a bounded part of the range to its mirror."""
    low, high = config.floor_percentile, 1 - config.floor_percentile
    stats = frames.groupBy(key).agg(F.percentile(level, F.lit(low)).alias("floor"), F.percentile(level, F.lit(high)).alias("peak"))
    delta = F.least(F.lit(config.delta_max_db), F.greatest(F.lit(config.delta_min_db), config.delta_factor * (F.col("peak") - F.col("floor"))))
    return stats.withColumn("threshold", F.col("floor") + delta)


def candidate(level: Column, threshold: Column, zcr: Column, config: Config = DEFAULT) -> Column:
    """Above the threshold, and either clearly so or with few zero crossings."""
    return (level > threshold) & ((level > threshold + 3) | (zcr <= config.zcr_max))


def hysteresis(rows: DataFrame, key: str, order: str, flag: str, enter: int, leave: int, out: str = "voiced") -> DataFrame:
    """rows with `out`: on after `enter` flags in a row, off after `leave` rows without. Two frames and a fill-forward."""
    w, x = _order(key, order), F.col(flag).cast("int")
    full = lambda n: F.count("*").over(w.rowsBetween(-(n - 1), 0)) == n
    on = full(enter) & (F.min(x).over(w.rowsBetween(-(enter - 1), 0)) == 1)
    off = full(leave) & (F.max(x).over(w.rowsBetween(-(leave - 1), 0)) == 0)
    rows = rows.withColumn("__turn", F.when(on, True).when(off, False))
    last = F.last("__turn", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(out, F.coalesce(last, F.lit(False))).drop("__turn")


def islands(rows: DataFrame, key: str, order: str, value: str, out: str = "run") -> DataFrame:
    """rows with `out`, the number of the run of equal `value` that each is in, from 0."""
    w = _order(key, order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return rows.withColumn("__c", change).withColumn(out, F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("__c")


def frame_segments(frames: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Segments of voiced frames (meeting_id, frame_idx, rms_db, voiced): start, end and mean level."""
    runs = islands(frames, "meeting_id", "frame_idx", "voiced").where("voiced")
    out = runs.groupBy("meeting_id", "run").agg((F.min("frame_idx") * config.hop_ms).cast("long").alias("start_ms"), (F.max("frame_idx") * config.hop_ms + config.frame_ms).cast("long").alias("end_ms"), F.avg("rms_db").alias("energy_db"))
    return numbered(out.drop("run"))


def numbered(segments: DataFrame) -> DataFrame:
    return segments.withColumn("seg_idx", (F.row_number().over(W.partitionBy("meeting_id").orderBy("start_ms", "end_ms")) - 1).cast("int"))


def merge_gaps(segments: DataFrame, gap_ms: int, inclusive: bool = False) -> DataFrame:
    """Segments whose gap is under gap_ms (or equal, if inclusive) become one, with its duration-weighted level."""
    w = _order("meeting_id", "start_ms")
    reach = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    apart = (F.col("start_ms") - reach > gap_ms) if inclusive else (F.col("start_ms") - reach >= gap_ms)
    rows = segments.withColumn("__n", F.when(reach.isNotNull() & ~apart, 0).otherwise(1)).withColumn("__g", F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    weight = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    out = rows.groupBy("meeting_id", "__g").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.try_divide(F.sum(F.col("energy_db") * weight), F.sum(weight)).alias("energy_db"))
    return numbered(out.drop("__g"))


def clip(segments: DataFrame, audio: DataFrame, least_ms: int) -> DataFrame:
    """Segments within [0, duration_ms) of audio (meeting_id, duration_ms) that last least_ms or more."""
    out = segments.join(audio.select("meeting_id", "duration_ms"), "meeting_id").withColumn("start_ms", F.greatest(F.col("start_ms"), F.lit(0))).withColumn("end_ms", F.least("end_ms", "duration_ms"))
    return numbered(out.where(F.col("end_ms") - F.col("start_ms") >= least_ms).drop("duration_ms", "seg_idx"))


def whole_if_none(segments: DataFrame, audio: DataFrame, least_ms: int) -> DataFrame:
    """One segment over a recording in which none was found, if it is long enough."""
    silent = audio.where(F.col("duration_ms") >= least_ms).join(segments, "meeting_id", "left_anti")
    whole = silent.select("meeting_id", F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").cast("long").alias("end_ms"), F.lit(-100.0).alias("energy_db"), F.lit(0).alias("seg_idx"))
    return segments.unionByName(whole, allowMissingColumns=True)


def units(segments: DataFrame, max_unit_ms: int = DEFAULT.max_unit_ms, gap_ms: int = DEFAULT.merge_gap_ms) -> DataFrame:
    """meeting_id, unit_idx, start_ms, end_ms, members: consecutive segments joined while the gap and the unit's
    length allow; each segment alone if max_unit_ms is 0. A fold, as the length restarts with each unit."""
    item = F.struct(F.col("start_ms").cast("long").alias("s"), F.col("end_ms").cast("long").alias("e"), F.col("seg_idx").cast("int").alias("i"))
    rows = segments.groupBy("meeting_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = "array<struct<s:bigint,e:bigint,m:array<int>>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (max_unit_ms > 0) & (x["s"] - last["e"] <= gap_ms) & (x["e"] - last["s"] <= max_unit_ms)
        grown = F.named_struct(F.lit("s"), last["s"], F.lit("e"), F.greatest(last["e"], x["e"]), F.lit("m"), F.concat(last["m"], F.array(x["i"])))
        fresh = F.named_struct(F.lit("s"), x["s"], F.lit("e"), x["e"], F.lit("m"), F.array(x["i"]))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    folded = rows.select("meeting_id", F.posexplode(F.aggregate("all", F.array().cast(kind), lambda a, x: F.when(F.size(a) == 0, F.array(F.named_struct(F.lit("s"), x["s"], F.lit("e"), x["e"], F.lit("m"), F.array(x["i"])))).otherwise(step(a, x)))).alias("unit_idx", "u"))
    return folded.select("meeting_id", "unit_idx", F.col("u.s").alias("start_ms"), F.col("u.e").alias("end_ms"), F.col("u.m").alias("members"))


def gap_to_next(segments: DataFrame) -> DataFrame:
    """segments with gap_ms to the next one, at least 0, null for the last."""
    nxt = F.lead("start_ms").over(_order("meeting_id", "seg_idx"))
    return segments.withColumn("gap_ms", F.when(nxt.isNotNull(), F.greatest(nxt - F.col("end_ms"), F.lit(0))))


def forward_fill(rows: DataFrame, key: str, order: str, value: str, default) -> DataFrame:
    last = F.last(value, ignorenulls=True).over(_order(key, order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(value, F.coalesce(last, F.lit(default)))


def smooth_isolated(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """A label between two equal others takes theirs, judged on the labels as they came."""
    w = _order(key, order)
    before, after = F.lag(label).over(w), F.lead(label).over(w)
    return rows.withColumn(label, F.when((before == after) & (before != F.col(label)), before).otherwise(F.col(label)))


def smooth_mode(rows: DataFrame, key: str, order: str, label: str, window: int) -> DataFrame:
    """The most frequent label of the window around each row, the smallest of equals."""
    half = window // 2
    near = F.collect_list(label).over(_order(key, order).rowsBetween(-half, half))
    count = lambda x: F.size(F.filter(F.col("__n"), lambda y: y == x))
    best = F.array_min(F.transform(F.array_distinct("__n"), lambda x: F.named_struct(F.lit("c"), -count(x), F.lit("v"), x)))
    return rows.withColumn("__n", near).withColumn(label, best["v"]).drop("__n")


def renumber(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Labels numbered from 0 by first appearance."""
    first = F.min(order).over(W.partitionBy(key, label))
    return rows.withColumn("__f", first).withColumn(label, (F.dense_rank().over(W.partitionBy(key).orderBy("__f")) - 1).cast("int")).drop("__f")


def turns(segments: DataFrame) -> DataFrame:
    """Runs of one speaker: meeting_id, turn_idx, speaker_id, start_ms, end_ms, n_segments."""
    runs = islands(segments, "meeting_id", "seg_idx", "speaker_id", "turn_idx")
    return runs.groupBy("meeting_id", "turn_idx", "speaker_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_segments"))


def share_time(pieces: DataFrame, key: list[str], order: str, chars: str) -> DataFrame:
    """pieces (with start_ms, end_ms of their segment) with piece_start and piece_end: time by characters, floored,
    each piece starting where the one before ends, none beyond the segment."""
    total = F.greatest(F.sum(chars).over(W.partitionBy(*key)), F.lit(1))
    span = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    rows = pieces.withColumn("__ms", F.floor(span * F.col(chars) / total).cast("long"))
    end = F.least(F.col("start_ms") + F.sum("__ms").over(W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)), "end_ms")
    rows = rows.withColumn("piece_end", end)
    start = F.coalesce(F.lag("piece_end").over(W.partitionBy(*key).orderBy(order)), "start_ms")
    return rows.withColumn("piece_start", start).drop("__ms")


def online_floor(rows: DataFrame, key: str, order: str, level: str, config: Config = DEFAULT) -> DataFrame:
    """rows with floor, which falls at once and rises by a step a frame, and peak, its mirror: running extremes."""
    w = _order(key, order)
    i = F.row_number().over(w)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__i", i)
    low = config.floor_rise_db * F.col("__i") + F.least(F.lit(config.start_db), F.min(F.col(level) - config.floor_rise_db * F.col("__i")).over(upto))
    high = -config.peak_fall_db * F.col("__i") + F.greatest(F.lit(config.start_db), F.max(F.col(level) + config.peak_fall_db * F.col("__i")).over(upto))
    return rows.withColumn("floor", low).withColumn("peak", high).drop("__i")


def speaker_count(merges: DataFrame, ratio: float = DEFAULT.jump_ratio, most: int = DEFAULT.max_speakers) -> DataFrame:
    """meeting_id, speakers: from merge distances (meeting_id, step, distance), how many clusters the largest relative
    jump leaves; one if no jump is large enough."""
    w = _order("meeting_id", "step")
    rows = merges.withColumn("__n", F.count("*").over(W.partitionBy("meeting_id"))).withColumn("__i", F.row_number().over(w) - 1)
    rows = rows.withColumn("__r", F.col("distance") / F.greatest(F.lag("distance").over(w), F.lit(1e-6)))
    rows = rows.where(F.col("__i") >= F.greatest(F.lit(1), F.col("__n") - most))
    best = rows.groupBy("meeting_id").agg(F.max_by(F.struct("__r", "__n", "__i"), F.struct("__r", -F.col("__i"))).alias("b"))
    many = F.when(F.col("b.__r") < max(1.05, ratio), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), F.col("b.__n") - F.col("b.__i"))))
    return merges.select("meeting_id").distinct().join(best.select("meeting_id", many.alias("m")), "meeting_id", "left").select("meeting_id", F.coalesce("m", F.lit(1)).cast("int").alias("speakers"))


def envelope(samples: DataFrame, key: str, order: str, value: str, bucket: int) -> DataFrame:
    """Least and greatest value of each bucket of rows, both taking in 0."""
    rows = samples.withColumn("bucket", F.floor(F.col(order) / bucket).cast("long"))
    return rows.groupBy(key, "bucket").agg(F.least(F.min(value), F.lit(0.0)).alias("low"), F.greatest(F.max(value), F.lit(0.0)).alias("high"))


def review(transcript: DataFrame, edits: DataFrame) -> DataFrame:
    """A transcript (meeting_id, seg_idx, start_ms, end_ms, speaker_id, text) after edits (meeting_id, seg_idx, op, value):
    `merge` into the segment above, `delete`, `speaker`, `text`. Confidence becomes 1."""
    acts = edits.groupBy("meeting_id", "seg_idx").agg(*[F.max(F.when(F.col("op") == op, F.coalesce("value", F.lit("")))).alias(f"__{op}") for op in ("merge", "delete", "speaker", "text")])
    rows = transcript.join(acts, ["meeting_id", "seg_idx"], "left").where("__delete is null")
    rows = rows.withColumn("text", F.coalesce("__text", "text")).withColumn("speaker_id", F.coalesce(F.col("__speaker").cast("int"), "speaker_id"))
    w = _order("meeting_id", "seg_idx")
    first = F.lag(F.lit(1)).over(w).isNull()
    rows = rows.withColumn("__g", F.sum(F.when(F.col("__merge").isNull() | first, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("seg_idx", "start_ms", "speaker_id", "text")))
    out = rows.groupBy("meeting_id", "__g").agg(parts.alias("p"), F.max("end_ms").alias("end_ms"))
    joined = F.array_join(F.filter(F.transform("p", lambda x: F.trim(x["text"])), lambda t: t != ""), "")
    head = F.element_at("p", 1)
    return out.select("meeting_id", head["seg_idx"].alias("seg_idx"), head["start_ms"].alias("start_ms"), "end_ms", head["speaker_id"].alias("speaker_id"), joined.alias("text"), F.lit(1.0).alias("confidence"))
