"""Recordings replayed as a stream of chunks, at a multiple of real time."""

from __future__ import annotations

import os
import time

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import wav

SCHEMA = "meeting_id string, chunk_seq long, sample_rate int, samples array<float>, last boolean"


class Chunks(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class ReplayReader(DataSourceStreamReader):
    """The offset is the number of chunks that are due by the clock, so no delay adds up from chunk to chunk."""

    def __init__(self, paths: list[str], speed: float, chunk_ms: int, started_at: float | None = None):
        self.paths, self.speed, self.chunk_ms = paths, speed if speed > 0 else 1.0, chunk_ms if chunk_ms > 0 else 100
        self.started_at = time.time() if started_at is None else started_at
        self.most = max((self._count(self._head(p)) for p in paths), default=0)

    def _head(self, path: str) -> dict:
        with open(path, "rb") as f:
            return wav.header(f.read(wav.HEAD), os.path.getsize(path))

    def _size(self, h: dict) -> int:
        return max(1, h["sample_rate"] * self.chunk_ms // 1000)

    def _count(self, h: dict) -> int:
        return -(-h["n_frames"] // self._size(h))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"chunk": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        due = int(max(0.0, time.time() - self.started_at) * 1000 * self.speed / self.chunk_ms) + 1
        return {"chunk": min(self.most, due)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["chunk"] < start["chunk"]:
            raise ValueError("the checkpoint is ahead of the clock: restart with the option startedAt of the first run")
        return [Chunks(p, start["chunk"], end["chunk"]) for p in self.paths]

    def read(self, partition: Chunks):
        """Only the bytes of the chunks asked for are read."""
        h = self._head(partition.path)
        size, count, width = self._size(h), self._count(h), h["bits"] // 8 * h["channels"]
        name = os.path.basename(partition.path).removesuffix(".wav")
        with open(partition.path, "rb") as f:
            f.seek(h["at"] + partition.first * size * width)
            for k in range(partition.first, min(partition.end, count)):
                n = min(size, h["n_frames"] - k * size)
                x = wav.decode(f.read(n * width), h | {"at": 0, "n_frames": n})
                yield name, k, h["sample_rate"], x.tolist(), k == count - 1

    def commit(self, end: dict) -> None:
        pass


class ReplaySource(DataSource):
    """spark.readStream.format("wav_replay") with options paths (a.wav,b.wav), speed (1) and chunkMs (100).

    startedAt (seconds since 1970; now) is when the first chunk was due: with the same value, a restarted query goes on
    where its checkpoint ends. Chunks have the file's own rate. Executors see the files at the same path as the driver; those that aren't WAV or
    hold no samples are an error at the start.
    """

    @classmethod
    def name(cls) -> str:
        return "wav_replay"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ReplayReader:  # noqa: N802
        reader = ReplayReader([p for p in self.options["paths"].split(",") if p], float(self.options.get("speed", 1)), int(self.options.get("chunkMs", 100)), float(self.options["startedAt"]) if "startedAt" in self.options else None)
        if not reader.most:
            raise ValueError("no samples to replay")
        return reader
