"""Suffix-array deduplication of bytes, by common-prefix interval trees.

Suffixes that start at a shared anchor meet in one bucket. There an enhanced suffix array holds them in
order with their common-prefix lengths; one scan with a stack yields the intervals of the common-prefix
tree, and how soon the bytes to the left of an interval's members diverge gives the maximal repeats that
they belong to, with all occurrences: not only neighbours in the array.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted
from .repeats import Kind, byte_units, merged, with_spans

#: Bytes of a repeated string, and of the anchors within it.
WINDOW, GRAM = 200, 50


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def prefix_intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each interval of the common-prefix tree of a suffix array whose
    neighbours have these common lengths: members first to last share `length`, and no more do."""
    stack: list[tuple[int, int]] = []
    for i, now in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def anchored_repeats(items: list[tuple[int, bytes, int]], window: int) -> list[tuple[int, int, int]]:
    """(item, start, stop) of the spans of each item that are part of a repeat of `window` bytes around its anchor.

    items: (place of the anchor, string, number of places where this very string occurs).
    """
    out = [(i, 0, len(s)) for i, (_, s, n) in enumerate(items) if n > 1]
    if len(items) < 2:
        return out
    right = [s[at:] for at, s, _ in items]
    left = [s[:at][::-1] for at, s, _ in items]
    array = sorted(range(len(items)), key=right.__getitem__)
    rank = {i: r for r, i in enumerate(sorted(range(len(items)), key=left.__getitem__))}
    most = max(map(len, left))
    for length, first, last in prefix_intervals([common_prefix(right[a], right[b]) for a, b in zip(array, array[1:])]):
        if length + most < window:
            continue
        members = sorted(array[first : last + 1], key=rank.__getitem__)
        diverge = [common_prefix(left[a], left[b]) for a, b in zip(members, members[1:])]
        for i, before, after in zip(members, [0, *diverge], [*diverge, 0], strict=True):
            back = max(before, after)
            if back + length >= window:
                out.append((i, items[i][0] - back, items[i][0] + length))
    return out


def cut_bytes(raw: bytes):
    return lambda start, stop: raw[start:stop]


def kind(window: int = WINDOW, gram: int = GRAM) -> Kind:
    return Kind(window, gram, 1, byte_units, cut_bytes, anchored_repeats)


def dedup_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (text and others) with n_bytes, n_removed, removed array<struct<start,stop>>, kept binary.

    Every byte covered by a string of `window` bytes that starts anywhere else too, in this or another
    row, goes; strings are judged on the input and never cross rows. A null text counts as empty; shorter
    texts never lose anything; rows that repeat lose all windows; no rows give no rows. Columns of these
    names are replaced. Cutting may split a character, so `kept` is bytes.
    """
    own = ("n_bytes", "n_removed", "removed", "kept")
    keep = [c for c in docs.columns if c.lower() not in own]
    rows, copied, covered = with_spans(docs.select(*map(quoted, keep)), kind(window, max(1, window // 4)))
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cut, runs, kept = [], [], [], []
            for t, copies, spans in zip(b.column("text"), b.column(copied).to_pylist(), b.column(covered).to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                gone = merged(spans, len(raw), (copies or 1) > 1, window)
                n.append(len(raw))
                cut.append(sum(z - a for a, z in gone))
                runs.append([{"start": a, "stop": z} for a, z in gone])
                edges = [0, *(x for pair in gone for x in pair), len(raw)]
                kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary())], [*keep, *own])

    pair = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    schema = T.StructType([*docs.select(*map(quoted, keep)).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", pair), T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """What a result of dedup_bytes comes to, row by row."""
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
