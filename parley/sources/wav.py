"""WAV recordings as rows: a decoder over bytes, a batch reader, and a data source that skips samples nobody selects."""

from __future__ import annotations

import os
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
HEAD = 1 << 16  # bytes within which headers end
INFO = "sample_rate int, channels int, bits int, encoding string, n_frames long, error string"


def header(raw: bytes, length: int | None = None) -> dict:
    """Format and place of the samples; raises ValueError for what is no WAV. A data chunk may be cut short.

    length is the file's, where raw is only its beginning.
    """
    if len(raw) < 44 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = at + 8
        if name == b"fmt " and size >= 16 and body + 16 <= len(raw):
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, body)
            if code == EXTENSIBLE and size >= 26:
                code = struct.unpack_from("<H", raw, body + 24)[0]
            fmt = code, channels, rate, bits
        elif name == b"data":
            if fmt is None:
                raise ValueError("data before format")
            code, channels, rate, bits = fmt
            if (code, bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}:
                raise ValueError(f"unsupported encoding {code} with {bits} bits")
            if not 1 <= channels <= 32 or not 1 <= rate <= 768000:
                raise ValueError("channels or rate out of range")
            width = bits // 8 * channels
            frames = max(0, min(size, (length or len(raw)) - body)) // width
            return {"sample_rate": rate, "channels": channels, "bits": bits, "encoding": "pcm" if code == PCM else "float", "n_frames": frames, "at": body}
        at = body + size + size % 2
    raise ValueError("no data chunk")


def decode(raw: bytes, info: dict | None = None) -> np.ndarray:
    """Samples from -1 to 1, the mean of all channels."""
    h = info or header(raw)
    n, bits = h["n_frames"] * h["channels"], h["bits"]
    body = raw[h["at"] : h["at"] + n * bits // 8]
    if h["encoding"] == "float":
        x = np.frombuffer(body, "<f4" if bits == 32 else "<f8").astype(np.float64)
    elif bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608
    else:
        x = np.frombuffer(body, f"<i{bits // 8}") / float(1 << (bits - 1))
    return x.reshape(-1, h["channels"]).mean(1).astype(np.float32)


def encode(x: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A mono file of 16-bit PCM, or of floats if bits is 32."""
    x = np.asarray(x, np.float64)
    body = x.astype("<f4").tobytes() if bits == 32 else np.round(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    fmt = struct.pack("<HHIIHH", FLOAT if bits == 32 else PCM, 1, rate, rate * bits // 8, bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def decode_rows(files: DataFrame, samples: bool = True) -> DataFrame:
    """files (path, content) with header fields, samples on demand, and an error instead of a failed job."""
    def run(batches):
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                try:
                    h = header(bytes(raw))
                    rows.append((path, h["sample_rate"], h["channels"], h["bits"], h["encoding"], h["n_frames"], None, decode(bytes(raw), h) if samples else None))
                except ValueError as e:
                    rows.append((path, None, None, None, None, None, str(e), None))
            out = pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "bits", "encoding", "n_frames", "error", "samples"])
            yield out if samples else out.drop(columns="samples")

    return files.select("path", "content").mapInPandas(run, "path string, " + INFO + (", samples array<float>" if samples else ""))


def read(spark: SparkSession, path: str, samples: bool = True) -> DataFrame:
    """All .wav files under a folder, or one file, wherever Spark reads it; meeting_id is the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    from pyspark.sql import functions as F

    return decode_rows(files, samples).withColumn("meeting_id", F.regexp_extract("path", r"([^/]+)\.wav$", 1))


class WavReader(DataSourceReader):
    def __init__(self, paths: list[str], head_only: bool):
        self.paths, self.head_only = paths, head_only

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        path = partition.value
        with open(path, "rb") as f:
            raw = f.read(HEAD) if self.head_only else f.read()
        h = header(raw, os.path.getsize(path))
        row = [path, h["sample_rate"], h["channels"], h["bits"], h["encoding"], h["n_frames"]]
        yield tuple(row if self.head_only else [*row, decode(raw, h).tolist()])


class WavSource(DataSource):
    """spark.read.format("wav").option("paths", "a.wav,b.wav"): files that every executor sees at the same path.

    With option headOnly, only the first 64 KiB of each are read and there is no samples column.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def _head(self) -> bool:
        return self.options.get("headOnly", "false").lower() == "true"

    def schema(self) -> str:
        return "path string, sample_rate int, channels int, bits int, encoding string, n_frames long" + ("" if self._head() else ", samples array<float>")

    def reader(self, schema):
        return WavReader([p for p in self.options["paths"].split(",") if p], self._head())
