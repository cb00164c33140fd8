import math
import random

import pytest
from pyspark.sql import functions as F

from parley.llm import topk


def brute(vectors, queries, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {i: [math.floor(256 * x) for x in v] for i, v in queries if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("clustered", [False, True])
def test_equals_brute_force(spark, clustered, monkeypatch):
    monkeypatch.setattr(topk, "FIRST_SCAN", 20)
    monkeypatch.setattr(topk, "CHUNK", (16, 64))
    rng = random.Random(3)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    data = []
    for i in range(400):
        m = middles[i % 5] if clustered else [0] * 8
        data.append((i, [a + rng.gauss(0, 0.2) for a in m]))
    data += [(400 + i, data[7][1]) for i in range(60)]  # a common vector
    data += [(900, None), (901, [1.0, None] * 4), (902, [float("nan")] * 8), (950, [float("inf")] * 8), (1000, [0.0] * 8), (1050, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, far string")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    got = rows(topk.top_k(df, df.where("vec_id % 50 = 0")))
    assert got == brute(exact, [x for x in exact if x[0] % 50 == 0], 5)


def test_fewer_rows_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [])], "vec_id long, embedding array<float>")
    assert rows(topk.top_k(df, df.where("vec_id = 0"))) == [(0, 1, 1, 128 * 256), (0, 2, 2, 0)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_rows_are_told_apart_by_row_not_by_id(spark):
    """Two rows of one id are two queries, and each finds the other."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), *((i, [0.5, 0.25 * (i % 3)]) for i in range(1, 9))]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(r["rank"] for r in got) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    twice = [(50, [1.0, 1.0])] * 2 + [(1, [0.1, 0.1])]
    got = topk.top_k(spark.createDataFrame(twice, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r)[1:3] for r in got) == [(1, 50), (1, 50), (2, 1), (2, 1)]
