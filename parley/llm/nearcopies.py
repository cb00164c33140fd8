"""Near copies by SimHash and exact Jaccard similarity of word shingles.

Fingerprints of 5-word shingles meet under their deletion-variant signatures, and the exact similarity of
the sets verifies what they find. Texts of similarity 0.8 differ in some 9 or 10 of 64 bits, though, a radius
at which no index of such fingerprints is selective. The rest comes from a prefix filter, which loses none:
under one order of all shingles, two sets that are similar enough share one of the first shingles of each.
The order puts rare shingles first, by a sketch that counts those of all texts: it never counts too few, so a
shingle that it counts once is in no other text and isn't sent. The sketch decides how many candidates there
are, not which pairs are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, shuffle_partitions, stage
from .components import components
from .repeats import ODD, Powers, grams, mix, word_units
from .simhash import links, majority

#: Words of a shingle; near copies have a similarity of NUM / DEN at least.
SHINGLE, NUM, DEN = 5, 4, 5
#: Bytes of text for each counter of the sketch, about a word; most counters, as a power of 2: 64 MB of levels, which all tasks get.
WORD_SIZE, MOST_BITS = 8, 27
#: Counters that travel together, as a power of 2; shingles that a task counts before it sends them; blocks that leave at once.
BLOCK_BITS, COUNTED, SENT = 18, 1 << 21, 64
#: Counts, or multiples of the mean count, at which the levels 2 to 15 begin.
STEPS = np.array([3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 1024])
#: Texts that a task remembers, so as to send each of them once; values that it holds before it sends them.
SEEN, HELD = 1 << 18, 1 << 17
#: Pairs of a bucket that a text is in at first, and how many times more each time that this leaves some out.
PAIRS, GROWTH = 2, 4
#: Bits of a set's parities, as a power of 2.
PLACES = 10


def shingle_set(raw: bytes, powers: Powers, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct runs of `shingle` words, A-Z lower-cased; a shorter text is one run, and no words are one too."""
    units = word_units(raw.lower())
    return np.unique(mix(grams(units, 0, min(shingle, len(units)), powers))) if len(units) else np.zeros(1, np.uint64)


def text_node(text: Column) -> Column:
    """64 bits that stand for a whole text; a null one is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def gathered(parts: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Parts, a numpy array or a list of such a column, as batches of HELD values or little more."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += sum(len(x) if isinstance(x, np.ndarray) else sum(map(len, x)) for x in part)
        if size >= HELD:
            yield gather(held, names)
            held, size = [], 0
    if held:
        yield gather(held, names)


def gather(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(c)) if isinstance(c[0], np.ndarray) else pa.array([x for own in c for x in own], pa.list_(pa.int64())) for c in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def node_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The node and the shingle set of each text of batches (node, text), once a task."""
    powers, seen = Powers(int(ODD[0])), set()
    for b in batches:
        for node, t in zip(b.column("node").to_pylist(), b.column("text"), strict=True):
            if node in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(node)
            yield node, shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", powers)


def sets_of(texts: DataFrame, schema: str, shape) -> DataFrame:
    """The rows of schema that shape(node, shingle set) makes of each text of texts (node, text), once a task."""
    names = [f.split()[0] for f in schema.split(",")]
    return texts.select("node", "text").mapInArrow(lambda batches: gathered((shape(*x) for x in node_sets(batches)), names), schema)


def planes(x: np.ndarray) -> bytes:
    """Small unsigned numbers, all their lowest bytes first: the zeros of the higher ones compress."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def counters(h: np.ndarray, bits: int) -> np.ndarray:
    """The counter of each shingle."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def levels(n: np.ndarray) -> np.ndarray:
    """0 where only one text can hold a shingle, else 1 to 15 by how common shingles are; where counters are shared, beside the mean."""
    return np.where(n < 2, 0, 1 + np.searchsorted(STEPS, n / max(1.0, float(n.mean())), side="right")).astype(np.uint8)


def counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """block, gaps, n: the counters of 2 ** bits that the shingles of batches (node, text) touch, and how often.

    Sets are made and counted in one process, by 4 bytes a shingle, and blocks leave a few at a time.
    """
    held, size = [], 0
    for _, s in node_sets(batches):
        held.append(counters(s, bits).astype(np.uint32))
        size += len(s)
        if size >= COUNTED:
            yield from touched(held)
            size = 0
    yield from touched(held)


def touched(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The batches of counted, of lists of counters, which it empties."""
    if not held:
        return
    at = np.concatenate(held)
    held.clear()
    at.sort()
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))).astype(np.uint32)
    n = np.diff(first, append=np.uint32(len(at)))
    at = at[first]
    cuts = [0, *(np.flatnonzero(np.diff(at >> BLOCK_BITS)) + 1).tolist(), len(at)]
    for i in range(0, len(cuts) - 1, SENT):
        rows = [(int(at[x] >> BLOCK_BITS), planes(np.diff(at[x:y], prepend=at[x] >> BLOCK_BITS << BLOCK_BITS)), planes(n[x:y])) for x, y in zip(cuts[i : i + SENT], cuts[i + 1 : i + 1 + SENT])]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "gaps", "n"])


def commonness(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Bits of a counter's place, and the levels of all counters, two a byte, of the shingles of all texts (node, text).

    A text counts once a task, so counters are never too low. Tasks send the counters that they touched; blocks of
    them are summed apart, and only levels reach the driver.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(BLOCK_BITS, (size // WORD_SIZE).bit_length()))
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, gaps, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = total.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint32))
                own[np.cumsum(unplaned(gaps))] += unplaned(n)
        for block, own in total.items():
            level = levels(own)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(level[::2] | level[1::2] << 4).tobytes()], pa.binary())], ["block", "levels"])

    sent = texts.select("node", "text").mapInArrow(lambda batches: counted(batches, bits), "block int, gaps binary, n binary")
    merged = sent.repartition(shuffle_partitions(texts.sparkSession), "block").mapInArrow(merge, "block int, levels binary")
    out, width = np.zeros(1 << (bits - 1), np.uint8), 1 << (BLOCK_BITS - 1)
    for r in merged.toLocalIterator():
        out[r.block * width : (r.block + 1) * width] = np.frombuffer(r.levels, np.uint8)
    return bits, out


def prefix(s: np.ndarray, bits: int, packed: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, of which any set that is similar enough has one among its own first; without those that no other text has."""
    m = len(s) - -(-NUM * len(s) // DEN) + 1
    at = counters(s, bits)
    level = packed[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15
    first = np.argsort(level, kind="stable")[:m]
    return s[first[level[first] > 0]]


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of whole buckets of rows that are sorted by h, the first column, some buckets at a time."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = [np.asarray(c.flatten()).reshape(b.num_rows, -1) if pa.types.is_list(c.type) else np.asarray(c) for c in b.columns]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on
        if cut:
            yield tuple(x[:cut] for x in rows)
        held = [x[cut:] for x in rows]
    if held is not None:
        yield tuple(held)


def shared_prefixes(texts: DataFrame) -> DataFrame:
    """h, n (size), node, and `before`, the node next below in size: the rows of the prefixes' shingles that two sets of near size have."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(commonness(texts))

    def entries(node: int, s: np.ndarray) -> tuple:
        p = prefix(s, *sent.value).view(np.int64)
        return p, np.full(len(p), len(s), np.int32), np.full(len(p), node, np.int64)

    rows = sets_of(texts, "h long, n int, node long", entries)
    rows = rows.repartition(shuffle_partitions(spark), "h").sortWithinPartitions("h", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n, node in buckets(batches):
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])  # equal texts of several tasks
            h, n, node = h[fresh], n[fresh], node[fresh]
            near = (h[1:] == h[:-1]) & (DEN * n[:-1].astype(np.int64) >= NUM * n[1:].astype(np.int64))
            after, ahead = np.concatenate(([False], near)), np.concatenate((near, [False]))
            keep = after | ahead
            if keep.any():
                before = pa.array(np.concatenate((node[:1], node[:-1]))[keep], mask=~after[keep])
                yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(n[keep]), pa.array(node[keep]), before], ["h", "n", "node", "before"])

    return rows.mapInArrow(run, "h long, n int, node long, before long")


def some_pairs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """Columns a, b of pairs of nodes that share a bucket (h, n, node, root, bits), have different roots and may be similar by size and parities.

    A row is in some `most` pairs of its bucket, so those of other roots than the commonest bound their number. Where that
    leaves pairs out, or may, the bucket's h is given once, as a pair of h and itself.
    """
    for h, n, node, root, own in buckets(batches):
        n, x, step = n.astype(np.int64), np.arange(len(h)), 0
        pairs, full = np.zeros(len(h), np.int32), []
        while len(x):  # each row with the one `step` below; sizes ascend, so a row that is done stays so
            step += 1
            x = x[x + step < len(h)]
            x = x[(h[x] == h[x + step]) & (DEN * n[x] >= NUM * n[x + step])]
            done = pairs[x] >= most
            full.append(np.unique(h[x[done]]))
            x = x[~done]
            for at in range(0, len(x), HELD):
                i = x[at : at + HELD]
                i = i[root[i] != root[i + step]]
                differ = np.bitwise_count((own[i] ^ own[i + step]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                i = i[(DEN + NUM) * differ <= (DEN - NUM) * (n[i] + n[i + step])]
                done = (pairs[i] >= most) | (pairs[i + step] >= most)
                full.append(np.unique(h[i[done]]))
                i = i[~done]
                if len(i):
                    pairs[i] += 1
                    pairs[i + step] += 1
                    yield np.minimum(node[i], node[i + step]), np.maximum(node[i], node[i + step])
        if full and len(full := np.unique(np.concatenate(full))):
            yield full, full


def apart(shared: DataFrame, roots: DataFrame, bits: DataFrame, most: int) -> DataFrame:
    """some_pairs of the nodes that share a row of `shared`, are in no component together so far and may be similar."""
    spark = shared.sparkSession
    rows = shared.join(roots, "node", "left").select("h", "n", "node", F.coalesce("root", "node").alias("root"))
    several = rows.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    rows = rows.join(several, "h").join(bits.select("node", "bits"), "node").select("h", "n", "node", "root", "bits")
    rows = rows.repartition(shuffle_partitions(spark), "h").sortWithinPartitions("h", "n", "node")
    return rows.mapInArrow(lambda batches: gathered(some_pairs(batches, most), ["a", "b"]), "a long, b long").distinct()


def parities(s: np.ndarray, places: int = PLACES) -> np.ndarray:
    """2 ** places bits, each whether an odd number of a set's shingles fall on it."""
    n = np.bincount((s & np.uint64((1 << places) - 1)).astype(np.int64), minlength=1 << places) & 1
    return np.packbits(n.astype(np.uint8)).view(np.int64)


def fine_parities(s: np.ndarray) -> np.ndarray:
    """Parities with 8 bits a shingle or more: an eighth of the set itself, and few shingles share a bit."""
    return parities(s, max(PLACES, (8 * len(s) - 1).bit_length()))


def may_be_similar(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (a, b) but for those whose parities (node, bits, n) prove that they aren't similar enough.

    Sets differ in no fewer shingles than bits, and similar ones in (DEN - NUM) / (DEN + NUM) of both sizes at most.
    Parities of twice the length are folded.
    """
    rows = pairs.join(bits.toDF("a", "ba", "na"), "a").join(bits.toDF("b", "bb", "nb"), "b")
    rows = rows.where((DEN * F.col("na") >= NUM * F.col("nb")) & (DEN * F.col("nb") >= NUM * F.col("na")))  # so that lengths are alike, or one twice the other
    half = lambda x: (F.size(x) / 2).cast("int")
    fold = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda v, w: v.bitwiseXOR(w))).otherwise(F.col(x))
    differ = F.aggregate(F.zip_with(fold("ba", "bb"), fold("bb", "ba"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return rows.where((DEN + NUM) * differ <= (DEN - NUM) * (F.col("na") + F.col("nb"))).select("a", "b")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts (node, text) whose sets are similar enough, by the sets themselves."""
    pairs = stage(pairs)
    nodes = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    sets = sets_of(texts.join(nodes, "node", "left_semi"), "node long, s array<long>, n int", lambda node, s: (np.array([node]), [s.view(np.int64)], np.array([len(s)], np.int32)))
    sets = stage(sets.dropDuplicates(["node"]))
    rows = pairs.join(sets.toDF("a", "sa", "na"), "a").join(sets.toDF("b", "sb", "nb"), "b")
    rows = rows.withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return stage(rows.where(DEN * F.col("both") >= NUM * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))


def near_copies(docs: DataFrame) -> DataFrame:
    """node, root of each distinct text of docs (text) that has a near copy; root is the least node that links reach.

    Links join sets of 5-word shingles with a Jaccard similarity of 0.8 or more; none is missed. What SimHash links,
    and neighbours in size, are compared first, and then only pairs that are not joined yet, a few of each text at a time,
    until no bucket has others left: a dense group is soon joined and never meets all pairs.
    """
    texts = docs.select(text_node(F.col("text")).alias("node"), "text")
    shared = stage(shared_prefixes(texts))
    nodes = stage(shared.select("node").distinct())
    shape = lambda node, s: (np.array([node]), [parities(s)], [fine_parities(s)], np.array([len(s)], np.int32), np.array([majority(s)], np.uint64).view(np.int64))
    known = stage(sets_of(texts.join(nodes, "node", "left_semi"), "node long, bits array<long>, fine array<long>, n int, fp long", shape).dropDuplicates(["node"]))
    bits, fine = known.select("node", "bits", "n"), known.select("node", "fine", "n")
    prints = stage(known.groupBy("fp").agg(F.min("node").alias("first")))
    alike = known.join(prints, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    close = links(prints.select("fp")).join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    beside = shared.where("before is not null").select(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b"))
    tried = stage(alike.union(close).union(beside).distinct())
    edges = similar(may_be_similar(stage(may_be_similar(tried, bits)), fine), texts)
    roots, most, more = stage(components(edges)), PAIRS, True
    while more:
        found = stage(apart(shared, roots, bits, most))
        pairs = stage(found.where("a < b").join(tried, ["a", "b"], "left_anti"))
        new = similar(may_be_similar(pairs, fine), texts)
        if not new.isEmpty():
            edges = stage(edges.union(new))
            roots = stage(components(edges))
        left = found.where("a = b").select(F.col("a").alias("h"))
        if more := not left.isEmpty():
            shared, tried, most = stage(shared.join(left, "h", "left_semi")), stage(tried.union(pairs)), GROWTH * most
    return roots


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and others) but for near copies: of each group one row stays, of the smallest id.

    Groups are what near_copies links; a null or empty text is a text like any other. Ids needn't tell rows apart:
    among rows of that id the text with the least key counts, null ids come last, and of rows alike in id and text the
    one with the least hash of all columns stays. Other columns stay as they are, whatever their names; no rows give no rows.
    """
    node, key, text = fresh(docs, "node"), fresh(docs, "key"), text_node(F.col("text"))
    values = [quoted(c).cast("string") for c in docs.columns]
    rows = docs.withColumns({node: text, key: F.xxhash64(*values, *[v.isNull() for v in values])})
    light = rows.select("doc_id", F.col(node).alias("node"), F.col(key).alias("key")).join(near_copies(docs), "node", "left")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "node", "key")
    first = stage(light.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(order).alias("f")).select(F.col("f.node").alias(node), F.col("f.key").alias(key)))
    return rows.join(first, [node, key]).dropDuplicates([node, key]).select(*map(quoted, docs.columns))
