import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import toxicity
from parley.llm.common import held_out


def make(spark):
    """Toxic where an insult meets a group; either alone is clean."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        words = [f"w{chr(97 + rng.randrange(20))}" for _ in range(20)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["fool"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(insult and group)))
    rows += [(5000, None, "x"), (5001, "", "x"), (None, "fool martians", "x"), (7, rows[7][1], "again")]
    labels += [(5002, 1), (None, 1), (5001, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, y string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_pairs_are_learnt(spark):
    docs, labels = make(spark)
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model)
    got = found.join(labels, "doc_id").where(held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).collect()
    assert len(got) > 150 and sum((r.score >= 0.5) == r.toxic for r in got) >= 0.98 * len(got)
    assert found.count() == docs.count() and all(0 <= r.score <= 1 for r in found.collect())


def test_one_class_and_empty_tables(spark):
    docs, labels = make(spark)
    model = toxicity.fit(docs, labels.where("toxic = 0"))
    assert all(r.score < 0.5 for r in toxicity.score(docs.limit(20), model).collect())
    model = toxicity.fit(docs.limit(0), labels)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score(docs.limit(5), model).collect()} == {0.5}


@pytest.mark.parametrize("rule", ["both", "one"])
def test_words_that_tell_only_in_pairs(spark, rule):
    """Labels that neither word shows alone: toxic with both or neither (or with just one), among other words."""
    rng = random.Random(8)
    docs, labels, want = [], [], {}
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        ws = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(20)] + ["insult"] * a + ["group"] * b
        rng.shuffle(ws)
        want[i] = int((a == b) == (rule == "both"))
        docs.append((i, " ".join(ws)))
        labels.append((i, want[i]))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(frame, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] == bool(want[i]) for i in held) >= 0.9 * len(held)


def test_very_long_texts(spark):
    """One word decides, wherever it lies in a text of a million words."""
    long = "word " * 10**6
    rows = [(i, f"some plain text {i} " + "scum " * (i % 2)) for i in range(200)] + [(1000, long + "scum"), (1001, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).where("doc_id >= 1000").collect()}
    assert got[1000] > 0.5 > got[1001]


def test_the_driver_holds_the_sample_as_arrays(spark, monkeypatch):
    """Terms reach the driver as 4 bytes each; as Python numbers they took ten times that."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(150))) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    seen = []

    def train(rows):
        seen.append((sum(len(at) for _, at in rows), tracemalloc.get_traced_memory()[1]))
        return toxicity.Model(np.full(2 * toxicity.BUCKETS, -1, np.int32), 0.0, np.zeros(0), np.zeros((0, toxicity.FACTORS)))

    monkeypatch.setattr(toxicity, "train", train)
    tracemalloc.start()
    toxicity.fit(docs, labels)
    tracemalloc.stop()
    terms, peak = seen[0]
    assert terms > 150_000 and peak < 16 * terms
