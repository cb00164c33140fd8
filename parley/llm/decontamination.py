"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A window as long as an item is a candidate if their SimHash fingerprints over word shingles differ in at
most RADIUS bits. Fingerprints are cut into BLOCKS blocks; of two within the radius, some block differs in
one bit at most, so looking up each block and its one-bit variants finds all of them. The weighted Jaccard
similarity of the shingles decides. A window without any shingle of the benchmark has similarity 0, so
only windows that hold one are fingerprinted.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage
from .repeats import text_key

SHINGLE, SIMILAR = 5, 0.8
#: Differing bits up to which a pair is verified; similarity 0.8 has 9 on average, and over 19 in one of some 5000.
RADIUS, BLOCKS = 19, 10
#: First bit of each block.
OFFSETS = tuple(64 * b // BLOCKS for b in range(BLOCKS + 1))
#: Votes of 3 bits share a long, 21 bits each: the most shingles of an item.
LANES, LANE_BITS = 22, 21
MOST_SHINGLES = (1 << LANE_BITS) - 1


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once for all its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column, size: int) -> Column:
    """Hashes of the runs of `size` words, in order."""
    each = lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<long>"))
    return let(words_of(text), each)


def simhash(hashes: Column) -> Column:
    """The majority of each bit over the shingles' hashes, repeats included."""
    mask = F.lit(1 | 1 << LANE_BITS | 1 << 2 * LANE_BITS)
    lanes = F.sequence(F.lit(0), F.lit(LANES - 1))
    spread = lambda h: F.transform(lanes, lambda i: F.when(i < LANE_BITS, F.call_function("shiftrightunsigned", h, i).bitwiseAND(mask)).otherwise(F.call_function("shiftrightunsigned", h, F.lit(63))))
    votes = F.aggregate(hashes, F.array_repeat(F.lit(0).cast("long"), LANES), lambda acc, h: F.zip_with(acc, spread(h), lambda a, b: a + b))

    def bit(v: Column, b: int) -> Column:
        lane, shift = (b % LANE_BITS, LANE_BITS * (b // LANE_BITS)) if b < 63 else (LANES - 1, 0)
        count = F.shiftrightunsigned(F.get(v, F.lit(lane)), shift).bitwiseAND(F.lit(MOST_SHINGLES))
        value = 1 << b if b < 63 else -(1 << 63)
        return F.when(count * 2 > F.size(hashes), F.lit(value)).otherwise(F.lit(0).cast("long"))

    def joined(v: Column) -> Column:
        out = bit(v, 0)
        for b in range(1, 64):
            out = out.bitwiseOR(bit(v, b))
        return out

    return let(votes, joined)


def block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, OFFSETS[b]).bitwiseAND(F.lit((1 << (OFFSETS[b + 1] - OFFSETS[b])) - 1)).cast("int")


def blocks(fp: Column) -> Column:
    """(block, value) of each block."""
    return F.array(*[F.struct(F.lit(b).alias("block"), block(fp, b).alias("value")) for b in range(BLOCKS)])


def block_variants(fp: Column) -> Column:
    """(block, value) of each block as it is and with any one bit changed."""
    flips = [(b, 0) for b in range(BLOCKS)] + [(b, 1 << i) for b in range(BLOCKS) for i in range(OFFSETS[b + 1] - OFFSETS[b])]
    return F.array(*[F.struct(F.lit(b).alias("block"), block(fp, b).bitwiseXOR(F.lit(x)).alias("value")) for b, x in flips])


def first_block(a: Column, b: Column) -> Column:
    """The first block in which two fingerprints differ in one bit at most: a pair counts there alone."""
    out = F.lit(None).cast("int")
    for n in reversed(range(BLOCKS)):
        out = F.when(F.bit_count(block(a, n).bitwiseXOR(block(b, n))) <= 1, F.lit(n)).otherwise(out)
    return out


def numbered(hashes: Column) -> Column:
    """Each hash with how often it came before, so that equal ones are told apart."""
    plain = F.transform(hashes, lambda h: F.named_struct(F.lit("h"), h, F.lit("n"), F.lit(0)))
    counted = F.transform(hashes, lambda h, i: F.named_struct(F.lit("h"), h, F.lit("n"), F.size(F.filter(F.slice(hashes, 1, i), lambda x: x == h))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), plain).otherwise(counted)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of numbered shingles."""
    return let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))


def contaminated(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """t1, t2 (a text's key), item_id, start, words, similarity: each item found in each text, at the most similar
    window, the first of equals.

    docs has text, benchmark item_id and text. Items shorter than a shingle count as one shingle of their own
    length; items without words, null texts and empty tables match nothing. Windows stop at the ends of a text,
    so a text shorter than an item is one window. Repeated rows of an item are one item. Letters' case and anything
    between words is ignored.
    """
    items = benchmark.select("item_id", "text").withColumn("n", F.size(words_of(F.col("text")))).where("n > 0").withColumn("size", F.least(F.lit(shingle), F.col("n")))
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # as many as a shingle has words, at most
    found = None
    for size in sizes:
        own = items_of(items.where(F.col("size") == size), size)
        part = windows_found(docs, own, size, similar)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.select(*[c.alias(n) for c, n in zip(text_key(F.col("text")), ("t1", "t2"), strict=True)]).limit(0).crossJoin(items.select("item_id").limit(0)).selectExpr("t1", "t2", "item_id", "0 as start", "0 as words", "cast(0 as double) as similarity")
    best = F.max_by(F.struct("start", "words", "similarity"), F.struct("similarity", -F.col("start")))
    return found.groupBy("t1", "t2", "item", "item_id").agg(best.alias("b")).select("t1", "t2", "item_id", "b.start", "b.words", "b.similarity")


def items_of(items: DataFrame, size: int) -> DataFrame:
    """Number, shingles, how many, and fingerprint of each item."""
    rows = items.withColumn("hashes", shingles(F.col("text"), size)).withColumn("m", F.size("hashes"))
    rows = rows.withColumn("m", F.when(F.col("m") <= MOST_SHINGLES, F.col("m")).otherwise(F.raise_error(F.lit("a benchmark item is too long"))).cast("int"))
    rows = rows.withColumn("item", F.xxhash64("item_id", "text")).dropDuplicates(["item"])
    return stage(rows.select("item", "item_id", "m", "hashes", simhash(F.col("hashes")).alias("fp")))


def windows_found(docs: DataFrame, items: DataFrame, size: int, similar: float) -> DataFrame:
    """(text, item, window) of the windows that are similar enough, for items of one shingle size."""
    t1, t2 = text_key(F.col("text"))
    texts = docs.where("text is not null").select(t1.alias("t1"), t2.alias("t2"), "text")
    # shingles of the benchmark, each with the sizes of the items that hold it
    known = stage(items.select("m", F.explode("hashes").alias("h")).distinct(), 1)
    each = texts.select("t1", "t2", F.posexplode(shingles(F.col("text"), size)).alias("p", "h"))
    hits = each.join(known, "h").groupBy("t1", "t2").agg(F.collect_set(F.struct("m", "p")).alias("hits"))
    hits = stage(hits)
    # only texts with hits go on, once each; their shingles are made again rather than carried
    # a merge join at every size: it may split hot texts, and its plan and shuffle grow evenly with the input
    rows = texts.join(hits.hint("merge"), ["t1", "t2"]).groupBy("t1", "t2").agg(F.first("text").alias("text"), F.first("hits").alias("hits"))
    rows = rows.withColumn("hashes", shingles(F.col("text"), size))
    starts = lambda x: F.transform(F.sequence(F.greatest(F.lit(0), x["p"] - x["m"] + 1), x["p"]), lambda s: F.named_struct(F.lit("m"), x["m"], F.lit("start"), s))
    rows = rows.select("t1", "t2", "hashes", F.explode(F.array_distinct(F.flatten(F.transform("hits", starts)))).alias("w"))
    rows = rows.select("t1", "t2", "w.m", "w.start", F.slice("hashes", F.col("w.start") + 1, F.col("w.m")).alias("own"))
    rows = rows.withColumn("print", simhash(F.col("own")))
    index = stage(items.select("item", "m", F.col("fp").alias("item_print"), F.explode(block_variants(F.col("fp"))).alias("k")).select("item", "m", "item_print", "k.block", "k.value"), 1)
    full = stage(items.select("item", "item_id", numbered(F.col("hashes")).alias("theirs")), 1)
    rows = rows.withColumn("k", F.explode(blocks(F.col("print")))).select("t1", "t2", "m", "start", "own", "print", "k.block", "k.value")
    pairs = rows.join(index, ["m", "block", "value"])
    pairs = pairs.where((F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS) & (first_block(F.col("print"), F.col("item_print")) == F.col("block")))
    pairs = pairs.join(full, "item").withColumn("similarity", similarity(numbered(F.col("own")), F.col("theirs"))).where(F.col("similarity") >= similar)
    return pairs.select("t1", "t2", "item", "item_id", "start", (F.size("own") + size - 1).alias("words"), "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, item_id, start, words, similarity: what contaminated() finds, for each row of docs that has the text."""
    t1, t2 = text_key(F.col("text"))
    found = stage(contaminated(docs, benchmark, similar))
    rows = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"))
    return rows.join(found, ["t1", "t2"]).select("doc_id", "item_id", "start", "words", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs whose texts hold no item; null texts and other columns stay."""
    t1, t2 = text_key(F.col("text"))
    own1, own2 = fresh(docs, "own1"), fresh(docs, "own2")
    found = stage(contaminated(docs.select("text"), benchmark, similar).select("t1", "t2").distinct()).toDF(own1, own2)
    return docs.join(found, (t1 == F.col(own1)) & (t2 == F.col(own2)), "left_anti")
