"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the terms that a text holds: the
factors let a pair, such as an insult and a group, weigh more than the two alone. Terms are words and
beginnings of words; those are kept that tell the classes apart by themselves or in a pair.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out

#: Labelled documents of each class that the model is fitted on, about: the bound of the sample.
SAMPLE = 6000
#: Buckets of words, and as many of beginnings of words; how long those are.
BUCKETS, BEGINNINGS = 1 << 18, (4, 5, 6)
#: Least squared deviation from the expected count, over that count, and rows for each term that tells by itself: a model has no more parameters than its rows can carry.
GAIN, ROWS_A_TERM = 6.0, 8
#: Share of the rows, and rows at least, that hold each word of a pair which tells together; chance that any pair of unrelated words does.
PAIR_SHARE, PAIR_ROWS, PAIR_CHANCE = 0.01, 10, 0.01
FACTORS, EPOCHS, BATCH, RATE, DECAY = 4, 60, 256, 0.02, 0.002
#: Words whose buckets a process remembers.
CACHE = 1 << 17

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """place: of each bucket among the kept ones, or -1; bias, weights and factors of those."""

    place: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, at: np.ndarray) -> float:
        """The chance that a text with the kept terms `at` is toxic."""
        v = self.factors[at]
        z = self.bias + float(self.weights[at].sum()) + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class Terms(dict):
    """The buckets of each word, and of its beginnings, remembered up to a bound; with `place`, their places, of those that have one."""

    def __init__(self, place: np.ndarray | None = None):
        super().__init__()
        self.place = place

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        raw = lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
        out = [raw(word), *(BUCKETS + raw(word[:n]) for n in BEGINNINGS if len(word) >= n)]
        if self.place is not None:
            out = [int(self.place[at]) for at in out if self.place[at] >= 0]
        found = self[word] = tuple(out)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """What a whole text's words, runs of letters in lower case, come to, each once."""
        out: set[int] = set()
        for own in map(self.__getitem__, set(WORD.findall(text.lower())) if text else ()):
            out.update(own)
        return np.fromiter(sorted(out), np.int64, len(out))


def telling(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Buckets that tell the classes apart by themselves: the best of them, as many as the rows can carry."""
    held, both = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for y, at in zip(label, rows, strict=True):
        held[at] += 1
        both[at] += y
    expected = held * label.mean()
    gain = (both - expected) ** 2 / (expected + 1) * (held >= 3)
    best = np.argsort(-gain, kind="stable")[: max(1, len(rows) // ROWS_A_TERM)]
    return best[gain[best] >= GAIN]


def telling_pairs(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Buckets of words that tell the classes apart in some pair, though perhaps not by themselves.

    The share of ones among the rows that hold both words of such a pair lies above, or below, that of either
    word by more than chance allows for any of all pairs. Words are looked at that a share of the rows hold.
    """
    many, least = len(rows), max(PAIR_ROWS, PAIR_SHARE * len(rows))
    held = np.zeros(2 * BUCKETS, np.int64)
    for at in rows:
        held[at] += 1
    held = held[:BUCKETS]
    words = np.flatnonzero((held >= least) & (held < many))
    place = np.full(2 * BUCKETS, -1)
    place[words] = np.arange(len(words))
    has = np.zeros((len(words), -(-many // 64) * 64), bool)
    for i, at in enumerate(rows):
        own = place[at]
        has[own[own >= 0], i] = True
    bits = np.packbits(has, axis=1).view(np.uint64)
    ones = np.packbits(np.pad(label > 0, (0, has.shape[1] - many))).view(np.uint64)
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    rate = count(bits & ones) / np.maximum(1, count(bits))
    bound = 2 * np.log(max(2.0, len(words) * (len(words) - 1) / 2) / PAIR_CHANCE)
    out: set[int] = set()
    for i in range(len(words) - 1):
        pair = bits[i] & bits[i + 1 :]
        n, k = count(pair), count(pair & ones)
        high, low = np.maximum(rate[i], rate[i + 1 :]), np.minimum(rate[i], rate[i + 1 :])
        beyond = np.where(k > n * high, high, np.where(k < n * low, low, np.nan))
        with np.errstate(invalid="ignore"):
            hit = np.flatnonzero((k - n * beyond) ** 2 >= bound * (n * beyond * (1 - beyond) + 1))
        if len(hit):
            out.add(i)
            out.update((hit + i + 1).tolist())
    return words[sorted(out)]


def train(rows: list[tuple[int, np.ndarray]], seed: int = 42) -> Model:
    """A model of (label, buckets) rows, by Adam on the log loss; without two classes, their smoothed share."""
    label, terms = np.array([y for y, _ in rows], float), [at for _, at in rows]
    ones, many = label.sum(), len(label)
    place = np.full(2 * BUCKETS, -1, np.int32)
    base = float(np.log((ones + 0.5) / (many - ones + 0.5)))
    if not 0 < ones < many:
        return Model(place, base, np.zeros(0), np.zeros((0, FACTORS)))
    kept = np.union1d(telling(terms, label), telling_pairs(terms, label))
    place[kept] = np.arange(len(kept))
    rng = np.random.default_rng(seed)
    p = [np.array([base]), np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS))]
    m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    table = np.zeros((many, len(kept)), np.uint8)  # a bounded sample by its terms, 20 to 40 MB about
    for i, at in enumerate(terms):
        own = place[at]
        table[i, own[own >= 0]] = 1
    for _ in range(EPOCHS):
        order = rng.permutation(many)
        for start in range(0, many, BATCH):
            batch = order[start : start + BATCH]
            x = table[batch].astype(np.float32)
            side = x @ p[2]
            z = p[0][0] + x @ p[1] + 0.5 * ((side**2).sum(1) - x @ (p[2] ** 2).sum(1))
            e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[batch]) / len(batch)
            g = [np.array([e.sum()]), x.T @ e + DECAY * p[1] / len(batch), x.T @ (e[:, None] * side) - p[2] * (x.T @ e)[:, None] + DECAY * p[2]]
            step += 1
            for i in range(3):
                m[i] += 0.1 * (g[i] - m[i])
                v[i] += 0.001 * (g[i] ** 2 - v[i])
                p[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(place, float(p[0][0]), p[1], p[2])


def sampled(rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """The label of each row (y, terms), and its terms as they lie in the table: 4 bytes each, where a Python list takes ten times that."""
    for b in rows.to_batches():
        ends = np.asarray(b.column("terms").offsets)
        terms = np.asarray(b.column("terms").values)
        for y, start, end in zip(b.column("y").to_pylist(), ends[:-1], ends[1:], strict=True):
            yield y, terms[start:end]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labelled documents that aren't held out: about `sample` of each class, by the hash of their id.

    Null labels and ids teach nothing; a label other than 0 counts as 1. Executors hash the texts; the
    driver gets the bounded sample's labels and terms. Where the classes are sampled unequally, the bias
    is shifted back to the odds of all labels.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", (F.col("toxic") != 0).cast("int").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("y") == y, min(1.0, sample / n)) for y, n in sizes.items()], F.lit(0.0))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)).collect()
    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("y", "integer")
    few = F.broadcast(spark.createDataFrame([(r.doc_id, r.y) for r in chosen], schema))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Terms()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([memory.of(t.as_py()).tolist() for t in b.column("text")], pa.list_(pa.int32()))], ["y", "terms"])

    rows = docs.select("doc_id", "text").join(few, "doc_id").select("y", "text").mapInArrow(terms, "y int, terms array<int>").toArrow()
    model = train(sorted(sampled(rows), key=lambda r: (r[0], r[1].tobytes())))
    if len(sizes) < 2:
        return model
    shift = sum((1 if y else -1) * math.log(max(1.0, n / sample)) for y, n in sizes.items())
    return replace(model, bias=model.bias + shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score`, 0 to 1, the chance that a whole text is toxic; a null or empty one has the base chance.

    Rows that repeat are scored each; no rows give no rows; a column named score is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        memory = Terms(m.place)
        for b in batches:
            found = [m.score(memory.of(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(found, pa.float64())], kept + ["score"])

    rows = docs.select(*kept)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
