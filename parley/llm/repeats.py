"""Repeated windows of a corpus: what suffix-array and substring deduplication have in common.

Texts are sequences of units, bytes or words. Every window of L units has an anchor: the k-gram in it
with the least hash, the first of those. Equal windows have equal anchors at equal offsets, and on
average an anchor serves many windows. A count-min sketch over anchors overestimates how often each
occurs, so a window whose anchor is estimated once is unique and goes no further. The sketch is sized by
the input, so that its load is the same at every size; where it would be too large to send to all tasks,
the anchors themselves are counted, and the texts joined with those that repeat. The rest is decided
exactly: stretches of windows meet under their anchor in buckets of fewer than HOT stretches, and
windows of more frequent anchors meet one by one, under 128 bits of their content, each sent once by each task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, shuffle_partitions

#: Rows of the sketch, counters of a row for each anchor expected, and how many counters travel together, as a power of 2.
SKETCH_ROWS, SPARE, BLOCK_BITS = 2, 4, 18
#: Most counters of a row, as a power of 2, of a sketch that is sent to all tasks: 2 bits of each, 64 MB in all.
MOST_BITS = 27
#: Occurrences from which an anchor's windows are sent one by one.
HOT = 128
#: Units that are hashed at once; anchors, or windows, that a task holds before it sends them.
PIECE, HELD = 1 << 19, 1 << 18
#: Words whose hashes, and texts whose keys, a process remembers.
WORDS, SEEN = 1 << 18, 1 << 18

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = (h ^ (h >> np.uint64(32))) * ODD[3]
    h = (h ^ (h >> np.uint64(29))) * ODD[1]
    return h ^ (h >> np.uint64(32))


@dataclass
class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, made as far as they are asked for."""

    base: int
    up: np.ndarray = field(default_factory=lambda: np.ones(1, np.uint64))
    down: np.ndarray = field(default_factory=lambda: np.ones(1, np.uint64))

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def grams(units: np.ndarray, starts: np.ndarray | int, ends: np.ndarray | int, powers: Powers) -> np.ndarray:
    """A hash of units[starts:ends] for each pair; for an int k instead of ends, of every run of k."""
    up, down = powers.get(len(units) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(units * up[: len(units)], dtype=np.uint64)))
    if isinstance(ends, int):
        k = ends
        return (total[k:] - total[:-k]) * down[: len(units) - k + 1]
    return (total[ends] - total[starts]) * down[starts]


def byte_units(raw: bytes) -> np.ndarray:
    return mix(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1))


class Hashes(dict):
    """XXH3 of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = Hashes()


def word_units(raw: bytes) -> np.ndarray:
    """A hash of each word of the UTF-8 text; words are set apart by bytes 0x20 and 0x09-0x0D."""
    words = raw.split()
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


@dataclass(frozen=True)
class Kind:
    """What repeats: windows of `window` units, of `size` bytes about, with anchors of `gram`; how to make units, cut a stretch, and decide a bucket."""

    window: int
    gram: int
    size: int
    units: Callable[[bytes], np.ndarray]
    cut: Callable[[bytes], Callable[[int, int], bytes]]
    bucket: Callable[[list[tuple[int, bytes, int]], int], list[tuple[int, int, int]]]


def anchors(units: np.ndarray, kind: Kind, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and hash of each anchor, and the first and last start of its windows."""
    out, wide = [], kind.window - kind.gram + 1
    for at in range(0, len(units) - kind.window + 1, PIECE):
        part = units[at : at + PIECE + kind.window - 1]
        h = mix(grams(part, 0, kind.gram, powers))
        low = np.uint64((1 << 20) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the least hash, the first of equals
        span = 1
        while span * 2 <= wide:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        many = len(part) - kind.window + 1
        key = np.minimum(key[:many], key[wide - span : wide - span + many])
        first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        pos = (key[first] & low).astype(np.int64)
        last = np.concatenate((first[1:] - 1, [many - 1]))
        out.append((pos + at, h[pos], first + at, last + at))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def slots(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """A counter of a row of the sketch for each hash."""
    return ((h * ODD[row]) >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(texts: DataFrame, kind: Kind) -> int:
    """Counters of a row of the sketch of texts (text), as a power of 2: SPARE for each anchor that texts of so many bytes have, about."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(BLOCK_BITS, math.ceil(math.log2(max(1, SPARE * 2 * size / kind.size / (kind.window - kind.gram + 2)))))


@dataclass(frozen=True)
class Sketch:
    """2 ** bits counters a row, and for each a bit: counted twice or more, and HOT times or more."""

    bits: int
    twice: np.ndarray
    hot: np.ndarray

    def at_least(self, bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row in range(SKETCH_ROWS):
            s = slots(h, row, self.bits)
            out &= (bits[row, s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
        return out


def sketch(texts: DataFrame, kind: Kind, bits: int) -> Sketch:
    """The merged sketch of all anchors of texts (text). Tasks send the counters that they touched;
    blocks of counters are summed apart, and only two bits of each reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size = Powers(int(ODD[0])), [], 0
        for b in batches:
            for t in b.column("text"):
                if t.is_valid and len(raw := t.as_buffer().to_pybytes()) >= kind.window:
                    held.append(anchors(kind.units(raw), kind, powers)[1])
                    size += len(held[-1])
                    if size >= HELD:
                        yield from send(held)
                        held, size = [], 0
        yield from send(held)

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h, rows = np.concatenate(held), []
        for row in range(SKETCH_ROWS):
            at, n = np.unique(slots(h, row, bits), return_counts=True)
            block = at >> BLOCK_BITS
            cuts = np.flatnonzero(np.diff(block)) + 1
            for own, many in zip(np.split(at, cuts), np.split(np.minimum(n, 255).astype(np.uint8), cuts), strict=True):
                if len(own):
                    rows.append((row, int(own[0] >> BLOCK_BITS), (own & ((1 << BLOCK_BITS) - 1)).astype(np.uint32).tobytes(), many.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], ["row", "block", "at", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for row, block, at, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                own = total.setdefault((row, block), np.zeros(1 << BLOCK_BITS, np.uint8))
                at, n = np.frombuffer(at, np.uint32), np.frombuffer(n, np.uint8)
                own[at] = np.minimum(own[at].astype(np.uint16) + n, 255)
        pack = lambda x: np.packbits(x, bitorder="little").tobytes()
        for (row, block), own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([pack(own >= 2)], pa.binary()), pa.array([pack(own >= HOT)], pa.binary())], ["row", "block", "twice", "hot"])

    counted = texts.select("text").mapInArrow(count, "row int, block int, at binary, n binary")
    merged = counted.repartition(shuffle_partitions(texts.sparkSession), "row", "block").mapInArrow(merge, "row int, block int, twice binary, hot binary")
    out = Sketch(bits, *(np.zeros((SKETCH_ROWS, 1 << (bits - 3)), np.uint8) for _ in range(2)))
    width = 1 << (BLOCK_BITS - 3)
    for r in merged.toLocalIterator():
        for flags, own in ((out.twice, r.twice), (out.hot, r.hot)):
            flags[r.row, r.block * width : (r.block + 1) * width] = np.frombuffer(own, np.uint8)
    return out


def with_counts(rows: DataFrame, kind: Kind) -> DataFrame:
    """The rows (text, t1, t2) whose anchors repeat, with `marks`: the position of each such anchor, and whether it occurs HOT times.

    Counts combine before the shuffle, and both joins may split hot keys; nothing is sent to all tasks.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(int(ODD[0]))
        for b in batches:
            for t, a1, a2 in zip(b.column("text"), b.column("t1").to_pylist(), b.column("t2").to_pylist(), strict=True):
                if len(raw := t.as_buffer().to_pybytes()) >= kind.window:
                    pos, h, _, _ = anchors(kind.units(raw), kind, powers)
                    for at in range(0, len(h), HELD):
                        own, place = h[at : at + HELD], pos[at : at + HELD]
                        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), a1)), pa.array(np.full(len(own), a2)), pa.array(place.astype(np.int32))], ["h", "t1", "t2", "at"])

    places = rows.mapInArrow(each, "h long, t1 long, t2 long, at int")
    counts = places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    marks = places.join(counts.hint("merge"), "h").groupBy("t1", "t2").agg(F.collect_set(F.struct("at", (F.col("n") >= HOT).alias("often"))).alias("marks"))
    return rows.join(marks.hint("merge"), ["t1", "t2"])


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a whole text."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


FIELDS = "k1 long, k2 long, lead int, stretch binary, t1 long, t2 long, start int, stop int"


def repeated_spans(texts: DataFrame, kind: Kind) -> DataFrame:
    """t1, t2 (the text's key), copies, spans: array of [start, stop) in units that repeated windows cover.

    Spans may overlap. Texts without any and with one copy are left out; a text with several copies has no
    spans, as every window of it repeats.
    """
    spark = texts.sparkSession
    t1, t2 = text_key(F.col("text"))
    rows = texts.where("text is not null").select("text", t1.alias("t1"), t2.alias("t2"))
    bits = sketch_bits(texts, kind)
    sent = spark.sparkContext.broadcast(sketch(texts, kind, bits)) if bits <= MOST_BITS else None

    def marked(h: np.ndarray, pos: np.ndarray, marks: list | None) -> tuple[np.ndarray, np.ndarray]:
        """Which anchors repeat, as far as is known, and which of them are hot."""
        if sent is not None:
            s = sent.value
            maybe = s.at_least(s.twice, h)
            return maybe, maybe & s.at_least(s.hot, h)
        return np.isin(pos, [m["at"] for m in marks]), np.isin(pos, [m["at"] for m in marks if m["often"]])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, powers, seen = xxhash.xxh3_128_digest, Powers(int(ODD[0])), set()
        cold, hot, size, many = [], [], 0, 0
        for b in batches:
            marks = b.column("marks").to_pylist() if sent is None else [None] * b.num_rows
            for t, a1, a2, own in zip(b.column("text"), b.column("t1").to_pylist(), b.column("t2").to_pylist(), marks, strict=True):
                if (a1, a2) in seen or len(raw := t.as_buffer().to_pybytes()) < kind.window:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()  # a text that is sent again repeats anyway
                seen.add((a1, a2))
                pos, h, first, last = anchors(kind.units(raw), kind, powers)
                maybe, often = marked(h, pos, own)
                if not maybe.any():
                    continue
                cut = kind.cut(raw)
                for i in np.flatnonzero(maybe & ~often).tolist():
                    start, stop = int(first[i]), int(last[i]) + kind.window
                    cold.append((int(h[i].view(np.int64)), 0, int(pos[i]) - start, cut(start, stop), a1, a2, start, stop))
                    size += len(cold[-1][3])
                    if size >= 8 * PIECE:
                        yield batch(cold)
                        cold, size = [], 0
                for a, z in zip(first[often].tolist(), last[often].tolist(), strict=True):
                    keys = np.frombuffer(b"".join([digest(cut(i, i + kind.window)) for i in range(a, z + 1)]), np.int64).reshape(-1, 2)
                    hot.append((keys[:, 0], keys[:, 1], np.full(len(keys), a1), np.full(len(keys), a2), np.arange(a, z + 1)))
                    many += len(keys)
                    if many >= HELD:
                        yield from once(hot, kind.window)
                        hot, many = [], 0
        yield batch(cold)
        yield from once(hot, kind.window)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in buckets(batches):
            out = part_spans(part, kind)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64() if i < 2 else pa.int32()) for i in range(4)], ["t1", "t2", "start", "stop"])

    met = (rows if sent is not None else with_counts(rows, kind)).mapInArrow(candidates, FIELDS).repartition(shuffle_partitions(spark), "k1", "k2").sortWithinPartitions("k1", "k2", "t1", "t2", "start")
    spans = met.mapInArrow(decide, "t1 long, t2 long, start int, stop int")
    spans = spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    copies = rows.groupBy("t1", "t2").agg(F.count("*").alias("copies")).where("copies > 1")
    found = copies.join(spans, ["t1", "t2"], "full_outer")
    return found.select("t1", "t2", F.coalesce("copies", F.lit(1)).alias("copies"), F.when(F.col("copies").isNull(), F.col("spans")).alias("spans"))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.split()[0] for f in FIELDS.split(", ")])


def once(held: list[tuple], window: int) -> Iterator[pa.RecordBatch]:
    """One row of each distinct window, and the rest of those that occur here twice; lead is -1 for the
    first, -2 if it is known to repeat, and -3 for rows that are decided already."""
    if not held:
        return
    k1, k2, t1, t2, start = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((start, t2, t1, k2, k1))
    k1, k2, t1, t2, start = (x[order] for x in (k1, k2, t1, t2, start))
    new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
    more = np.concatenate((~new[1:], [False]))  # another follows
    first = np.flatnonzero(new)
    rest = ~new
    lead = np.where(more[first], -2, -1)
    parts = [(first, lead)]
    known = np.flatnonzero(rest)
    # neighbouring windows of a text that are decided already travel as one row
    if len(known):
        by = known[np.lexsort((start[known], t2[known], t1[known]))]
        gap = np.concatenate(([True], (t1[by][1:] != t1[by][:-1]) | (t2[by][1:] != t2[by][:-1]) | (start[by][1:] > start[by][:-1] + window)))
        heads = np.flatnonzero(gap)
        tails = np.concatenate((heads[1:], [len(by)])) - 1
        done = (t1[by][heads], t2[by][heads], start[by][heads], start[by][tails] + window)
    else:
        done = tuple(np.zeros(0, np.int64) for _ in range(4))
    n, d = len(first), len(done[0])
    cols = [
        pa.array(np.concatenate((k1[first], done[0] ^ done[2]))), pa.array(np.concatenate((k2[first], done[1]))),
        pa.array(np.concatenate((parts[0][1], np.full(d, -3))).astype(np.int32)), pa.nulls(n + d, pa.binary()),
        pa.array(np.concatenate((t1[first], done[0]))), pa.array(np.concatenate((t2[first], done[1]))),
        pa.array(np.concatenate((start[first], done[2])).astype(np.int32)), pa.array(np.concatenate((start[first] + window, done[3])).astype(np.int32)),
    ]
    yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in FIELDS.split(", ")])


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, sorted by k1 and k2 as they are, cut only between keys; a key of windows, not of stretches, may be cut."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        part = pa.Table.from_batches([b])
        part = pa.concat_tables([held, part]) if held is not None else part
        k1, k2 = part.column("k1").to_numpy(), part.column("k2").to_numpy()
        same = (k1 == k1[-1]) & (k2 == k2[-1])
        cut = int(np.argmax(same))
        if cut:
            yield part.slice(0, cut)
        held = part.slice(cut)
        if held.num_rows > HELD:
            # one window in very many tasks: two of its rows stand for all that went before
            yield held
            held = held.slice(held.num_rows - 1)
            held = held.set_column(2, "lead", pa.array([-2], pa.int32()))
    if held is not None:
        yield held


def part_spans(part: pa.Table, kind: Kind) -> list[tuple[int, int, int, int]]:
    """Spans of whole buckets."""
    k1, k2, lead, t1, t2, start, stop = (part.column(c).to_numpy() for c in ("k1", "k2", "lead", "t1", "t2", "start", "stop"))
    stretch = part.column("stretch")
    out = []
    done = lead == -3
    out += zip(t1[done].tolist(), t2[done].tolist(), start[done].tolist(), stop[done].tolist(), strict=True)
    # windows: a key repeats if one of its rows says so, or two are of different places
    at = np.flatnonzero((lead == -1) | (lead == -2))
    if len(at):
        new = np.concatenate(([True], (k1[at][1:] != k1[at][:-1]) | (k2[at][1:] != k2[at][:-1])))
        group = np.cumsum(new) - 1
        move = np.concatenate(([False], (t1[at][1:] != t1[at][:-1]) | (t2[at][1:] != t2[at][:-1]) | (start[at][1:] != start[at][:-1]))) & ~new
        hit = np.bincount(group, weights=move | (lead[at] == -2)) > 0
        own = at[hit[group]]
        if len(own):
            own = own[np.lexsort((start[own], t2[own], t1[own]))]
            gap = np.concatenate(([True], (t1[own][1:] != t1[own][:-1]) | (t2[own][1:] != t2[own][:-1]) | (start[own][1:] > stop[own][:-1])))
            heads = np.flatnonzero(gap)
            tails = np.concatenate((heads[1:], [len(own)])) - 1
            out += zip(t1[own[heads]].tolist(), t2[own[heads]].tolist(), start[own[heads]].tolist(), stop[own[tails]].tolist(), strict=True)
    at = np.flatnonzero(lead >= 0)
    if len(at):
        ends = np.concatenate((np.flatnonzero(k1[at][1:] != k1[at][:-1]) + 1, [len(at)])).tolist()
        begin = 0
        for end in ends:
            own = at[begin:end].tolist()
            begin = end
            if len(own) < 2:
                continue
            places: dict[tuple[int, bytes], set[tuple[int, int, int]]] = {}
            for i in own:
                places.setdefault((int(lead[i]), stretch[i].as_py()), set()).add((int(t1[i]), int(t2[i]), int(start[i])))
            items = [(a, s, len(p)) for (a, s), p in places.items()]
            if len(items) == 1 and items[0][2] == 1:
                continue
            found = kind.bucket(items, kind.window)
            where = list(places.values())
            out += [(x, y, z + a, z + b) for i, a, b in found for x, y, z in where[i]]
    return out


def merged(spans: list, n: int, whole: bool, window: int) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover; all of n units where each window repeats."""
    if whole:
        return [(0, n)] if n >= window else []
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, kind: Kind) -> tuple[DataFrame, str, str]:
    """docs with the copies and spans of each row's text, and the names of these columns; the text's key finds them, and hot keys may be split."""
    t1, t2 = text_key(F.col("text"))
    names = [fresh(docs, n) for n in ("own1", "own2", "key1", "key2", "copies", "spans")]
    k1, k2, *found = names
    spans = repeated_spans(docs.select("text"), kind).toDF(*found)
    rows = docs.withColumns({k1: t1, k2: t2}).join(spans, (F.col(k1) == F.col(found[0])) & (F.col(k2) == F.col(found[1])), "left")
    return rows.select(*[quoted(c) for c in docs.columns], *found[2:]), found[2], found[3]
