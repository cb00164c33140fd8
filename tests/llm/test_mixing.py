import random

import pytest

from parley.llm import mixing


def plain_targets(sizes):
    """Shares by weight; what is above twice the size is dealt again until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        left = budget - sum(full.values())
        rest = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s: 2.0 * sizes[s] for s in rest if share[s] > 2 * sizes[s]}
        if not over:
            return full | share
        full |= over


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    names = ["b", "a", "Z", "é", None, "", "hot"]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(names) if rng.random() < 0.6 else "hot") for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", "only empty"), (3, "x y", "a"), (3, "x y", "a"), (None, "p q r", None), (n + 2, "w " * 5000, "b")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")


def test_targets_and_taken(spark):
    rows, docs = corpus(spark)
    got = mixing.mix(docs, shard_tokens=500).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets = plain_targets(sizes)
    for source, size in sizes.items():
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {size}
        assert own[0].target == pytest.approx(targets[source])
        assert abs(sum(r.taken for r in own) - targets[source]) <= 2
    assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_reruns_agree_however_dealt(spark):
    _, docs = corpus(spark)
    runs = [sorted(map(str, mixing.mix(d, shard_tokens=300).collect())) for d in (docs, docs.repartition(7), docs.orderBy("text"))]
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 12345])
def test_apportionment_equals_highest_quotients(spark, seats):
    rng = random.Random(seats)
    weights = {i: rng.choice([0, 1, 5, 17, 1000, 3.5]) for i in range(23)}
    won = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = max(weights, key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    df = spark.createDataFrame([(i, float(w), seats) for i, w in weights.items()], "k long, w double, n long")
    assert {r.k: r.won for r in mixing.apportion(df, [], "k", "w", "n", "won").collect()} == won


def test_empty_tables(spark):
    _, docs = corpus(spark, 5)
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = docs.selectExpr("doc_id", "cast(null as string) text", "source")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0, 0.0, 0)}


def test_empty_texts_are_in_no_shard(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "", "a") for i in range(50)] + [(100, "one two", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.taken) for r in mixing.mix(docs).collect()) == [*((i, 0, 0) for i in range(50)), (100, 2, 3)]
