"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves; of two that differ in 3 bits or fewer, one half differs
in one bit at most, so the two share that half with some one bit blanked. Every fingerprint is listed
under its 64 variants; equal variants meet in one bucket and are compared exactly. A bucket yields
only edges that join its members, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage
from .components import components

SHINGLE, RADIUS = 3, 3
#: Members of a bucket that are compared pair by pair; larger ones are cut again by the other half.
DIRECT = 2048
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 15


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        votes += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority of the bits of the XXH64 of each shingle; A-Z lower-cased, no words: 0."""
    import xxhash

    words = text.encode().lower().split() if text else []  # bytes: both touch ASCII alone
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    return majority(np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs within radius that join the same members as all such pairs do.

    Each member is compared once, with those not reached so far: a dense group is soon exhausted.
    """
    edges, left = [], np.arange(len(values))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = np.bitwise_count(values[left] ^ values[x]) <= radius
            if close.any():
                found = left[close].tolist()
                edges += [(x, y) for y in found]
                queue += found
                left = left[~close]
    return edges


def bucket_edges(values: np.ndarray, seg: int, radius: int) -> list[tuple[int, int]]:
    """Index pairs that join the members of a bucket, which agree on half `seg` but for one bit.

    A large bucket is cut by each quarter in the other half, one of which differs in one bit at most,
    with that bit blanked: its parts agree on all but 18 bits.
    """
    if len(values) <= DIRECT:
        return forest(values, radius)
    edges, other = [], (values >> np.uint64(32 * (1 - seg))) & np.uint64(0xFFFFFFFF)
    for quarter in (0, 1):
        part = (other >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
        for bit in range(16):
            key = part & ~np.uint64(1 << bit)
            order = np.argsort(key, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(group) > 1:
                    edges += [(int(group[a]), int(group[b])) for a, b in forest(values[group], radius)]
    return edges


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints with the components that links within radius have."""
    if not 0 <= radius <= 3:
        raise ValueError("two halves and one blank bit find up to 3 differing bits")
    bits = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    half = F.when(F.col("bit") < 32, low).otherwise(high)
    blank = F.expr("shiftleft(1L, bit % 32)")
    keys = prints.select("fp", bits).select("fp", F.col("bit").cast("byte").alias("bit"), half.bitwiseAND(F.bitwise_not(blank)).alias("key"))
    keys = keys.repartition(shuffle_partitions(prints.sparkSession), "bit", "key").sortWithinPartitions("bit", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in _with_end(batches):
            if b is None:
                now, held = held, None
            else:
                rows = [np.asarray(b.column(i)) for i in range(3)]
                rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
                last = (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])  # the last bucket may go on
                cut = int(np.argmax(last))
                now, held = [x[:cut] for x in rows], [x[cut:] for x in rows]
            if now is None or not len(now[0]):
                continue
            fp, bit, key = now
            cuts = np.flatnonzero((np.diff(bit) != 0) | (np.diff(key) != 0)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
            out = []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                own = fp[s:e]
                out += [(int(own[x]), int(own[y])) for x, y in bucket_edges(own.view(np.uint64), int(bit[s] >= 32), radius)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return keys.mapInArrow(run, "a long, b long").distinct()


def _with_end(batches: Iterator) -> Iterator:
    yield from (b for b in batches if b.num_rows)
    yield None


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links, the row's own included. A null, empty or
    blank text has fingerprint 0 and links like any other. Rows that repeat get a result each; a row
    with a null doc_id takes part and gets its component's smallest id, null if all of them are null.
    No rows give no rows; other columns are not looked at.
    """
    prints = stage(fingerprints(docs, shingle))
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(stage(links(distinct.select("fp"), radius))).withColumnsRenamed({"node": "fp"})
    labelled = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = stage(labelled.join(ids, "root").select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")
