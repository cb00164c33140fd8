"""Exact top-k by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and the ring of its distance from it. A query sorts the
rings by the best score that the triangle inequality leaves open, scans the first of them, and then
only the rings that may still hold a score as good as its k-th. Rings and queries meet in chunks of
bounded size; the scores are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import stage

#: Pivots, and least rings of each; more rows have more rings, so that cells are as many as the square root of the rows.
PIVOTS, RINGS = 16, 8
#: Vectors that a query scans before it bounds the rest, at least.
FIRST_SCAN = 1024
#: Rows of a chunk: a 200th of all, within these bounds.
CHUNK = (256, 8192)
#: Queries that meet a chunk at once.
QUERY_BLOCK = 2048


def usable(v: Column) -> Column:
    """True for vectors that take part: no null, NaN or infinite component."""
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors stored as bytes of doubles, short ones padded with zeros."""
    out = np.zeros((len(column), dim))
    for i, x in enumerate(column):
        v = np.frombuffer(x.as_buffer())
        out[i, : len(v)] = v
    return out


def bounds(q: np.ndarray, pivots: np.ndarray, cells: list[tuple]) -> np.ndarray:
    """For each query and cell (pivot, ring, least and greatest distance, greatest norm, rows) a score that none in it exceeds."""
    at = np.array([c[0] for c in cells])
    low, high, norm = (np.array([c[i] for c in cells], float) for i in (2, 3, 4))
    own = np.sqrt((q**2).sum(1))[:, None]
    away = np.sqrt(np.maximum(0, own**2 + (pivots**2).sum(1)[None] - 2 * q @ pivots.T))[:, at]
    by_ring = (own**2 + norm**2 - np.maximum(0, np.maximum(away - high, low - away)) ** 2) / 2
    by_pivot = (q @ pivots.T)[:, at] + own * high
    return np.minimum(np.minimum(by_ring, by_pivot), own * norm) * (1 + 1e-9) + 1e-3


def top_k(vectors: DataFrame, queries: DataFrame | Column, k: int = 5, scale: float = 256.0, seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best rows (all, if fewer).

    Tables have vec_id and embedding; components count as floor(scale * x). Ties go to the smaller vec_id. A condition
    makes queries of the rows of `vectors` that it holds for: each such row is a query, and finds every row but
    itself, also others of its id. In a table of queries, rows alike in id and vector are one query, and rows with the
    query's id are its own and never found. Vectors that are null or hold a null or non-finite component take no part;
    shorter vectors are padded with zeros. Repeated rows of `vectors` are found each. A null vec_id is no query and is
    found last among ties. Empty tables give no rows. Other columns are not looked at.
    """
    spark, by_row = vectors.sparkSession, isinstance(queries, Column)
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [np.floor(scale * np.asarray(x.values, float)).tobytes() for x in b.column("embedding")]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("asks"), pa.array(whole, pa.binary())], ["vec_id", "asks", "v"])

    def integers(df: DataFrame, asks: Column) -> DataFrame:
        good = df.where(usable(F.col("embedding"))).select("vec_id", "embedding", F.coalesce(asks, F.lit(False)).alias("asks"))
        return good.mapInArrow(rounded, f"vec_id {id_type}, asks boolean, v binary")

    base = stage(integers(vectors, queries if by_row else F.lit(False)).withColumn("row", F.monotonically_increasing_id()))
    size = base.agg(F.count("*").alias("n"), F.max(F.length("v")).alias("bytes")).first()
    if not size.n:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score long")
    if by_row:
        asked = base.where("asks and vec_id is not null").select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), "v")
    else:
        asked = integers(queries, F.lit(True)).where("vec_id is not null").select(F.col("vec_id").alias("query_id"), "v").distinct()
        asked = stage(asked.withColumn("q", F.monotonically_increasing_id()).select("q", "query_id", "v"))
    picked = base.select("v").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(PIVOTS).collect()
    dim = max(size.bytes, asked.agg(F.max(F.length("v"))).first()[0] or 0) // 8
    pivots = np.unique(matrix(pa.array([bytes(r.v) for r in picked], pa.binary()), max(dim, 1)), axis=0)
    dim = max(dim, 1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column("v"), dim)
            square = (m**2).sum(1)
            far = np.sqrt(np.maximum(0, square[:, None] + (pivots**2).sum(1)[None] - 2 * m @ pivots.T))
            near = far.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("v"), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(m)), near]), pa.array(np.sqrt(square))], ["row", "vec_id", "v", "pivot", "far", "norm"])

    index = stage(base.select("row", "vec_id", "v").mapInArrow(keyed, f"row long, vec_id {id_type}, v binary, pivot int, far double, norm double"))
    rings = max(RINGS, math.isqrt(size.n) // PIVOTS)
    reach = {r.pivot: r.reach for r in index.groupBy("pivot").agg(F.max("far").alias("reach")).collect()}
    widths = F.element_at(F.array(*[F.lit(max(reach.get(p, 0.0), 1e-9) / rings) for p in range(len(pivots))]), F.col("pivot") + 1)
    index = index.withColumn("cell", F.col("pivot") * rings + F.least(F.lit(rings - 1), F.floor(F.col("far") / widths)).cast("int"))
    chunk = min(max(size.n // 200, CHUNK[0]), CHUNK[1])
    directory = stage(index.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.max("norm").alias("norm"), F.count("*").alias("n")))
    cells = [(r.cell // rings, r.cell, r.low, r.high, r.norm, r.n) for r in directory.orderBy("cell").collect()]  # as many as the square root of the rows
    index = index.join(directory.select("cell", F.ceil(F.col("n") / chunk).alias("many")), "cell").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("many")).cast("int")).select("cell", "chunk", "row", "vec_id", "v")

    def wanted(first: bool):
        """The cells of each query's first scan, or those left that may hold a score of at least `least`; a query's block goes by its nearest pivot."""
        numbers, sizes = np.array([c[1] for c in cells]), np.array([c[5] for c in cells])
        chunks = -(-sizes // chunk)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                m = matrix(b.column("v"), dim)
                most = bounds(m, pivots, cells)
                if first:
                    order = np.argsort(-most, axis=1, kind="stable")
                    rows = sizes[order]
                    which, place = np.nonzero(np.cumsum(rows, axis=1) - rows < FIRST_SCAN)
                    at, least = order[which, place], np.full(b.num_rows, -np.inf)
                else:
                    least = np.array([-np.inf if x is None else x for x in b.column("least").to_pylist()])
                    left = most >= least[:, None]
                    for i, done in enumerate(b.column("done").to_pylist()):
                        left[i, np.searchsorted(numbers, done)] = False
                    which, at = np.nonzero(left)
                near = ((m[:, None] - pivots[None]) ** 2).sum(2).argmin(1) if len(m) * pivots.size < 1 << 24 else (-2 * m @ pivots.T + (pivots**2).sum(1)).argmin(1)
                many = chunks[at]
                each = np.repeat(np.arange(len(at)), many)
                part = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
                own = pa.array(which[each])
                yield pa.RecordBatch.from_arrays([b.column("q").take(own), b.column("query_id").take(own), b.column("v").take(own), pa.array(least[which[each]]), pa.array(near.astype(np.int32)[which[each]]), pa.array(numbers[at[each]].astype(np.int32)), pa.array(part.astype(np.int32))], ["q", "query_id", "v", "least", "pivot", "cell", "chunk"])

        return run

    def scan(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, rows = right.column("vec_id").to_pylist(), right.column("row").to_numpy()
            tie = np.array([np.iinfo(np.int64).max if x is None else x for x in ids])
            scores = matrix(left.column("v").combine_chunks(), dim) @ matrix(right.column("v").combine_chunks(), dim).T
            for q, own, least, s in zip(left.column("q").to_pylist(), left.column("query_id").to_pylist(), left.column("least").to_pylist(), scores, strict=True):
                s = np.where(rows == q if by_row else tie == own, -np.inf, s)
                at = np.flatnonzero(s >= max(np.partition(s, -k)[-k] if len(s) > k else -np.inf, least, -1e300))
                out += [(q, own, ids[i], int(s[i])) for i in at[np.lexsort((tie[at], -s[at]))][:k].tolist()]
        types = (pa.int64(), left.schema.field("query_id").type, right.schema.field("vec_id").type, pa.int64())
        return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(zip(("q", "query_id", "vec_id", "score"), types, strict=True))})

    queries_of = asked.count()
    blocks = -(-queries_of // QUERY_BLOCK)
    groups = max(1, min(len(pivots), blocks))  # of pivots: queries of one group ask for much the same cells

    def meet(asks: DataFrame) -> DataFrame:
        """The k best of each query in each chunk that it asks for; a chunk goes only to the blocks of queries that ask for its cell."""
        asks = stage(asks.withColumn("block", F.col("pivot") % groups + groups * F.pmod(F.xxhash64("q"), F.lit(-(-blocks // groups)))).drop("pivot"))
        pairs = asks.select(F.col("cell").alias("c"), F.col("block").alias("b")).distinct()
        sides = index.join(pairs, index["cell"] == pairs["c"]).select("cell", "chunk", F.col("b").alias("block"), "row", "vec_id", "v")
        return asks.groupBy("cell", "chunk", "block").cogroup(sides.groupBy("cell", "chunk", "block")).applyInArrow(scan, f"q long, query_id {id_type}, vec_id {id_type}, score long")

    if not queries_of:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score long")
    probes = f"q long, query_id {id_type}, v binary, least double, pivot int, cell int, chunk int"
    ranked = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    best = lambda df: df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    first = stage(asked.mapInArrow(wanted(True), probes))
    done = first.groupBy("q").agg(F.collect_set("cell").alias("done"))
    early = stage(best(meet(first)))
    least = early.where(F.col("rank") == k).select("q", F.col("score").cast("double").alias("least"))
    late = meet(asked.join(done, "q").join(least, "q", "left").mapInArrow(wanted(False), probes))
    return best(early.drop("rank").unionByName(late)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
