"""Substring deduplication of words: a count-min prefilter, then exact groups.

The merged sketches of all partitions overestimate how often a window of words occurs, so a window that
they count once is unique. Only the others are sent on; they meet under their anchors, and windows of the
same words are grouped exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted
from .repeats import Kind, merged, with_spans, word_units

#: Words of a window, and of the anchors within it.
WINDOW, GRAM = 35, 12


def cut_words(raw: bytes):
    """The words from start to stop with single spaces."""
    words = raw.split()  # on the ASCII white space 0x20, 0x09-0x0D
    joined, ends = b" ".join(words), list(accumulate((len(w) + 1 for w in words), initial=0))
    return lambda start, stop: joined[ends[start] : ends[stop] - 1]


def equal_windows(items: list[tuple[int, bytes, int]], window: int) -> list[tuple[int, int, int]]:
    """(item, start, stop) of the runs of windows of each item that occur more than once.

    items: (place of the anchor, words, number of places where these very words occur). Equal windows lie
    alike about the anchor, so they are grouped by place and words.
    """
    first: dict[tuple[int, bytes], int] = {}
    hits: list[set[int]] = [set() for _ in items]
    sizes = []
    for i, (at, s, n) in enumerate(items):
        ends = [p for p, c in enumerate(s) if c == 0x20] + [len(s)]
        starts = [0, *(e + 1 for e in ends[:-1])]
        sizes.append(len(ends))
        if n > 1:
            hits[i].update(range(len(ends) - window + 1))
        for w in range(len(ends) - window + 1):
            key = (w - at, s[starts[w] : ends[w + window - 1]])
            other = first.setdefault(key, i)
            if other != i:
                hits[i].add(w)
                hits[other].add(w - at + items[other][0])
    out = []
    for i, found in enumerate(hits):
        run: list[int] = []
        for w in sorted(found):
            if run and w <= run[1]:
                run[1] = w + window
            else:
                if run:
                    out.append((i, *run))
                run = [w, w + window]
        if run:
            out.append((i, *run))
    return out


def kind(window: int = WINDOW, gram: int = GRAM) -> Kind:
    return Kind(window, gram, 5, word_units, cut_words, equal_windows)


def dedup_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (text and others) with n_words, n_removed, removed array<struct<start,stop>> in words, kept string.

    Words are runs of anything but ASCII white space. Every word covered by a window of `window` words whose
    sequence starts anywhere else too, in this or another row, goes; windows are judged on the input and never
    cross rows. `kept` joins the rest by single spaces. A null text has no words; shorter texts never lose
    any; rows that repeat lose all windows; no rows give no rows. Columns of these names are replaced.
    """
    own = ("n_words", "n_removed", "removed", "kept")
    keep = [c for c in docs.columns if c.lower() not in own]
    rows, copied, covered = with_spans(docs.select(*map(quoted, keep)), kind(window, max(1, window // 3)))
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cut, runs, kept = [], [], [], []
            for t, copies, spans in zip(b.column("text"), b.column(copied).to_pylist(), b.column(covered).to_pylist(), strict=True):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                gone = merged(spans, len(words), (copies or 1) > 1, window)
                n.append(len(words))
                cut.append(sum(z - a for a, z in gone))
                runs.append([{"start": a, "stop": z} for a, z in gone])
                edges = [0, *(x for pair in gone for x in pair), len(words)]
                kept.append(b" ".join(w for a, z in zip(edges[::2], edges[1::2], strict=True) for w in words[a:z]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary()).cast(pa.string())], [*keep, *own])

    pair = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    schema = T.StructType([*docs.select(*map(quoted, keep)).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", pair), T.StructField("kept", T.StringType())])
    return rows.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """What a result of dedup_words comes to, row by row."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
