"""Live segmentation and captions: chunks of samples in, closed speech segments and their texts out."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Config
from ..functions import chinese, text as tx

OUTPUT = "meeting_id string, seg_idx int, start_ms long, end_ms long, energy_db double"
SOUND = ", sample_rate int, slice_start_ms long, samples array<float>"


class Segmenter:
    """The state of one meeting: samples of an unfinished frame, running floor and peak, and the open segment.

    With sound, it also keeps the last samples, enough for the longest segment and a margin, so that `cut` can give them.
    """

    def __init__(self, rate: int, config: Config = DEFAULT, sound: bool = False):
        self.rate, self.config, self.sound = rate, config, sound
        self.heard, self.dropped = np.zeros(0, np.float32), 0
        self.size, self.hop = max(2, rate * config.frame_ms // 1000), max(1, rate * config.hop_ms // 1000)
        self.rest, self.frame, self.count = np.zeros(0), 0, 0
        self.floor = self.peak = config.start_db
        self.run = self.quiet = 0
        self.open: list | None = None  # first frame, last voiced frame, levels

    KEPT = ("rate", "rest", "frame", "count", "floor", "peak", "run", "quiet", "open", "sound", "heard", "dropped")

    def saved(self) -> bytes:
        return pickle.dumps([getattr(self, k) for k in self.KEPT])

    @classmethod
    def restored(cls, kept: bytes, config: Config) -> Segmenter:
        values = pickle.loads(kept)  # noqa: S301
        out = cls(values[0], config)
        for name, value in zip(cls.KEPT, values, strict=True):
            setattr(out, name, value)
        return out

    def feed(self, samples: np.ndarray) -> list[tuple]:
        """Segments that these samples close; one that grew too long is closed after them."""
        c, out = self.config, []
        x = np.concatenate((self.rest, np.asarray(samples, float)))
        at = 0
        while at + self.size <= len(x):
            out += self._frame(x[at : at + self.size])
            at += self.hop
        self.rest = x[at:]
        if self.sound:
            self.heard = np.concatenate((self.heard, np.asarray(samples, np.float32)))
        if self.open and (self.frame - self.open[0]) * c.hop_ms >= c.live_max_segment_ms:
            out += self.close()
        return out

    def cut(self, start_ms: int, end_ms: int) -> tuple[int, np.ndarray]:
        """Start and samples of a segment with padding on both sides, as far as they are kept."""
        first = max(max(0, start_ms - self.config.pad_ms) * self.rate // 1000, self.dropped)
        last = min((end_ms + self.config.pad_ms) * self.rate // 1000, self.dropped + len(self.heard))
        return first * 1000 // self.rate, self.heard[first - self.dropped : max(first, last) - self.dropped]

    def forget(self) -> None:
        """Drops samples that no segment can need any more."""
        extra = len(self.heard) - (self.config.live_max_segment_ms + self.config.live_margin_ms) * self.rate // 1000
        if extra > 0:
            self.heard, self.dropped = self.heard[extra:].copy(), self.dropped + extra

    def _frame(self, f: np.ndarray) -> list[tuple]:
        c, out = self.config, []
        rms = float(np.sqrt((f**2).mean()))
        db = 20 * np.log10(rms) if rms > 1e-5 else -100.0
        crossings = float(np.diff(np.signbit(f)).sum()) / (len(f) - 1)
        self.floor = min(self.floor + c.floor_rise_db, db)
        self.peak = max(self.peak - c.peak_fall_db, db)
        threshold = self.floor + min(c.delta_max_db, max(c.delta_min_db, c.delta_factor * (self.peak - self.floor)))
        voiced = db > threshold and (db > threshold + 3 or crossings <= c.zcr_max)
        self.run, self.quiet = (self.run + 1, 0) if voiced else (0, self.quiet + 1)
        if self.open is None and self.run >= c.enter_frames:
            self.open = [self.frame - c.enter_frames + 1, self.frame, [db]]
        elif self.open is not None:
            self.open[2].append(db)
            if voiced:
                self.open[1] = self.frame
            if self.quiet >= c.live_exit_frames:
                out = self.close()
        self.frame += 1
        return out

    def close(self) -> list[tuple]:
        """The open segment up to its last voiced frame, if it is long enough."""
        if self.open is None:
            return []
        first, last, levels = self.open
        self.open, self.run = None, 0
        start, end = max(0, first) * self.config.hop_ms, last * self.config.hop_ms + self.config.frame_ms
        if end - start < self.config.live_min_speech_ms:
            return []
        self.count += 1
        return [(self.count - 1, start, end, float(np.mean(levels)))]


class LiveProcessor(StatefulProcessor):
    """Keeps a Segmenter for each meeting; chunks of a batch are taken in their order. A chunk with last set ends it."""

    def __init__(self, config: Config = DEFAULT, sound: bool = False):
        self.config, self.sound = config, sound

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("segmenter", "blob binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        chunks = pd.concat(list(rows)).sort_values("chunk_seq")
        kept = self.state.get() if self.state.exists() else None
        s = Segmenter.restored(bytes(kept[0]), self.config) if kept else Segmenter(int(chunks["sample_rate"].iloc[0]), self.config, self.sound)
        columns = ["meeting_id", "seg_idx", "start_ms", "end_ms", "energy_db"] + (["sample_rate", "slice_start_ms", "samples"] if self.sound else [])
        out = []
        for samples, last in zip(chunks["samples"], chunks["last"]):
            closed = s.feed(np.asarray(samples, float))
            if last:
                closed += s.close()
            for r in closed:
                at, x = s.cut(r[1], r[2]) if self.sound else (None, None)
                out.append((key[0], *r, s.rate, at, x.tolist()) if self.sound else (key[0], *r))
            s.forget()
        if chunks["last"].iloc[-1]:
            self.state.clear()  # a meeting that has ended leaves nothing behind
        else:
            self.state.update((s.saved(),))
        yield pd.DataFrame(out, columns=columns)

    def close(self) -> None:
        pass


def segment_stream(chunks: DataFrame, config: Config = DEFAULT, sound: bool = False) -> DataFrame:
    """Segments of a stream of chunks (meeting_id string, chunk_seq, sample_rate, samples, last boolean).

    With sound, each row also holds its padded samples, for a recogniser. Needs the RocksDB state store provider.
    """
    return chunks.groupBy("meeting_id").transformWithStateInPandas(statefulProcessor=LiveProcessor(config, sound), outputStructType=OUTPUT + (SOUND if sound else ""), outputMode="Append", timeMode="None")


def captions(segments: DataFrame, recognise: Callable[[DataFrame], DataFrame], characters: dict[str, str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """Segments with text as recognise adds it: simplified characters, digits, then punctuation. What says nothing goes.

    Row by row, so that streams and tables give the same captions.
    """
    said = recognise(segments).withColumn("text", tx.trim(F.coalesce("text", F.lit(""))))
    said = said.where((F.col("text") != "") & ~tx.blank_speech(F.col("text")))
    text = chinese.normalize_udf(tx.convert_characters(F.col("text"), characters or {}))
    said = said.withColumn("text", chinese.punctuate_udf(text, F.lit(config.live_gap_ms)))
    return said.where("text <> ''")


def gap_sessions(events: DataFrame, key: str, ts: str, gap: str, lateness: str) -> DataFrame:
    """Session windows of events, batch or stream, with late rows bounded by a watermark."""
    return events.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start_ts"), F.col("s.end").alias("end_ts"), "n")


def latency_stats(segments: DataFrame) -> DataFrame:
    """Running totals of a live session: segments that say something, mean and largest latency, characters."""
    said = F.trim("text") != ""
    return segments.agg(F.count_if(said).alias("n_segments"), F.try_divide(F.sum("latency_ms"), F.count_if(said)).alias("mean_latency_ms"), F.max("latency_ms").alias("max_latency_ms"), F.sum(F.octet_length("text")).alias("n_bytes"))
