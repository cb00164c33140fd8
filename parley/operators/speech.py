"""Operators from samples to segments and speakers. audio: meeting_id, sample_rate, samples array<float>."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import signal
from ..functions import vectors as vec
from . import timeline as tl
from .rank import gathered


def _each(audio: DataFrame, function, schema: str) -> DataFrame:
    """Rows that function(meeting_id, rate, samples) yields as tuples, meeting by meeting."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches):
        for b in batches:
            rows = [r for m, rate, x in zip(b["meeting_id"], b["sample_rate"], b["samples"]) for r in function(m, int(rate), np.asarray(x, np.float64))]
            yield pd.DataFrame(rows, columns=names)

    return audio.select("meeting_id", "sample_rate", "samples").mapInPandas(run, schema)


def _id(audio: DataFrame) -> str:
    return audio.schema["meeting_id"].dataType.simpleString()


def frame_levels(audio: DataFrame, config: Config = DEFAULT) -> DataFrame:
    def run(m, rate, x):
        db, zcr = signal.levels(x, rate, config.frame_ms, config.hop_ms)
        return zip([m] * len(db), range(len(db)), db.tolist(), zcr.tolist())

    return _each(audio, run, f"meeting_id {_id(audio)}, frame_idx int, rms_db double, zcr double")


def quality(audio: DataFrame) -> DataFrame:
    return _each(audio, lambda m, rate, x: [(m, *signal.quality(x, rate).values())], f"meeting_id {_id(audio)}, duration_ms long, peak_db double, rms_db double, clipping double, offset double, near_silent_ms long")


def resample(audio: DataFrame, rate: int = 16000) -> DataFrame:
    return _each(audio, lambda m, r, x: [(m, rate, signal.resample(x, r, rate).astype(np.float32))], f"meeting_id {_id(audio)}, sample_rate int, samples array<float>")


def voice_activity(audio: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Speech segments of each recording; one over all of it where none is found."""
    frames = frame_levels(audio, config)
    thresholds = tl.percentile_threshold(frames, "meeting_id", "rms_db", config)
    frames = frames.join(thresholds, "meeting_id").withColumn("cand", tl.candidate(F.col("rms_db"), F.col("threshold"), F.col("zcr"), config))
    frames = tl.hysteresis(frames, "meeting_id", "frame_idx", "cand", config.enter_frames, config.exit_frames)
    length = audio.select("meeting_id", F.floor(F.size("samples") * 1000 / F.col("sample_rate")).cast("long").alias("duration_ms"))
    found = tl.merge_gaps(tl.frame_segments(frames, config), config.min_silence_ms)
    return tl.whole_if_none(tl.clip(found, length, config.min_speech_ms), length, config.min_speech_ms)


def _with_audio(segments: DataFrame, audio: DataFrame, function, schema: str) -> DataFrame:
    """function(meeting_id, rate, samples, segments) on each recording and its segments in order."""
    each = gathered(segments, "segs", "seg_idx", "start_ms", "end_ms").join(audio.select("meeting_id", "sample_rate", "samples"), "meeting_id")
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches):
        for b in batches:
            rows = []
            for m, rate, x, segs in zip(b["meeting_id"], b["sample_rate"], b["samples"], b["segs"]):
                rows += function(m, int(rate), np.asarray(x, np.float64), pd.DataFrame(list(segs)))
            yield pd.DataFrame(rows, columns=names)

    return each.mapInPandas(run, schema)


def refine(segments: DataFrame, audio: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Segments cut to max_segment_ms where they are quietest, with their level measured again."""
    least = max(50, config.min_speech_ms // 2)

    def run(m, rate, x, rows):
        cut = [p for s, e in zip(rows["start_ms"], rows["end_ms"]) for p in signal.split_long(x, rate, int(s), int(e), config.max_segment_ms)]
        for i, (s, e) in enumerate(p for p in cut if p[1] - p[0] >= least):
            part = x[s * rate // 1000 : e * rate // 1000]
            rms = float(np.sqrt((part**2).mean())) if len(part) else 0.0
            yield m, i, s, e, 20 * np.log10(rms) if rms > 1e-5 else -100.0

    return _with_audio(segments, audio, run, f"meeting_id {_id(audio)}, seg_idx int, start_ms long, end_ms long, energy_db double")


def embeddings(segments: DataFrame, audio: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """meeting_id, seg_idx, features for segments long enough."""
    def run(m, rate, x, rows):
        for i, s, e in zip(rows["seg_idx"], rows["start_ms"], rows["end_ms"]):
            if e - s >= config.min_embed_ms and len(v := signal.embedding(x[int(s) * rate // 1000 : int(e) * rate // 1000], rate)):
                yield m, int(i), v.astype(np.float32)

    return _with_audio(segments, audio, run, f"meeting_id {_id(audio)}, seg_idx int, features array<float>")


def cluster(vectors: DataFrame, count: int = 0, config: Config = DEFAULT) -> DataFrame:
    """meeting_id, seg_idx, speaker_id: agglomerative clusters of each meeting's vectors; without a count, the largest
    jump of merge distances gives it, or else the threshold stops."""
    def run(key, rows):
        rows = rows.sort_values("seg_idx")
        v = list(rows["features"])
        if len(v) < 2:
            labels = [0] * len(v)
        elif count:
            labels, _ = signal.agglomerate(v, count)
        else:
            _, merges = signal.agglomerate(v, 1)
            k = signal.jump_count(merges, config.jump_ratio, config.max_speakers)
            labels, _ = signal.agglomerate(v, k) if k > 1 else signal.agglomerate(v, 0, config.cluster_threshold)
        return pd.DataFrame({"meeting_id": [key[0]] * len(v), "seg_idx": rows["seg_idx"].astype("int32"), "speaker_id": np.array(labels, np.int32)})

    return vectors.groupBy("meeting_id").applyInPandas(run, f"meeting_id {_id(vectors)}, seg_idx int, speaker_id int")


def weighted_centroids(vectors: DataFrame, key: str, weight: str) -> DataFrame:
    """key, features: the mean of each key's unit vectors (features) by weight, at length 1."""
    rows = vectors.select(key, weight, F.posexplode(vec.unit(F.col("features"))).alias("k", "x"))
    mean = rows.groupBy(key, "k").agg((F.sum(F.col("x") * F.col(weight)) / F.sum(weight)).alias("x"))
    return mean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("all")).select(key, vec.unit(F.transform("all", lambda p: p["x"])).alias("features"))


def nearest(vectors: DataFrame, queries: DataFrame, decimals: int = 6, block: int = 1024) -> DataFrame:
    """query_id, vec_id, distance: for each query (vec_id, features) the row of another id at the least cosine distance, ties to the smaller id.

    Queries and rows meet in blocks: a task holds one block of queries and one part of the rows at a time.
    """
    spark = vectors.sparkSession
    parts, blocks = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, -(-queries.count() // block))
    key = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("vec_id", "features", key(blocks).alias("block")).withColumn("part", spread(parts))
    rows = vectors.select("vec_id", "features", key(parts).alias("part")).withColumn("block", spread(blocks))

    def matrix(df: pd.DataFrame) -> np.ndarray:
        m = np.array(df["features"].tolist(), float).reshape(len(df), -1)
        n = np.sqrt((m**2).sum(1, keepdims=True))
        return np.divide(m, n, out=np.zeros_like(m), where=n > 1e-12)

    def best(key: tuple, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})
        v = v.sort_values("vec_id")
        far = np.round(np.clip(1 - matrix(q) @ matrix(v).T, 0, 2), decimals) + 0.0
        far[q["vec_id"].to_numpy()[:, None] == v["vec_id"].to_numpy()[None]] = np.inf
        at = far.argmin(1)
        out = pd.DataFrame({"query_id": q["vec_id"].to_numpy(), "vec_id": v["vec_id"].to_numpy()[at], "distance": far[np.arange(len(q)), at]})
        return out[np.isfinite(out["distance"])]

    met = asked.groupBy("block", "part").cogroup(rows.groupBy("block", "part")).applyInPandas(best, "query_id long, vec_id long, distance double")
    return met.groupBy("query_id").agg(F.min(F.struct("distance", "vec_id")).alias("b")).select("query_id", "b.vec_id", "b.distance")


def diarize(segments: DataFrame, vectors: DataFrame, count: int = 0, config: Config = DEFAULT) -> DataFrame:
    """segments with speaker_id: clusters, then labels carried forward, smoothed and numbered by first appearance."""
    rows = segments.drop("speaker_id").join(cluster(vectors, count, config), ["meeting_id", "seg_idx"], "left")
    rows = tl.forward_fill(rows, "meeting_id", "seg_idx", "speaker_id", 0)
    if config.smooth_window >= 5:
        rows = tl.smooth_mode(rows, "meeting_id", "seg_idx", "speaker_id", config.smooth_window)
    elif config.smooth_window >= 3:
        rows = tl.smooth_isolated(rows, "meeting_id", "seg_idx", "speaker_id")
    return tl.renumber(rows, "meeting_id", "seg_idx", "speaker_id")


def slices(segments: DataFrame, audio: DataFrame, pad_ms: int = DEFAULT.pad_ms) -> DataFrame:
    """segments with their samples, padded and clipped, and from where they start."""
    a = audio.select("meeting_id", "sample_rate", "samples")
    rows = segments.join(a, "meeting_id")
    to = lambda ms: F.floor((ms * F.col("sample_rate") + 500) / 1000).cast("int")
    start, end = F.greatest(F.lit(0), to(F.col("start_ms") - pad_ms)), F.least(F.size("samples"), to(F.col("end_ms") + pad_ms))
    rows = rows.withColumn("from_ms", F.floor(start * 1000 / F.col("sample_rate")).cast("long"))
    return rows.withColumn("samples", F.slice("samples", start + 1, F.greatest(F.lit(0), end - start)))
