"""Language identification: scripts narrow the candidates, Viterbi labels spans.

Every word of a text has a score under each language from a naive Bayes model over hashed character
trigrams. Its script narrows the candidates to languages that are written in it. Viterbi over the
words, with a penalty for each switch, labels spans; a document gets the language of most of its letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out

#: Documents of each language that the model is fitted on, about: the bound of the sample.
SAMPLE = 1500
#: Buckets of trigrams; what a switch costs, in nats; what a word outside a language's scripts costs.
BUCKETS, SWITCH, FOREIGN = 1 << 15, 8.0, 50.0
#: A language is written in a script that holds such a share of its letters.
SCRIPT_SHARE = 0.005
#: Code points that are scored at once.
CHUNK = 1 << 20
#: The first code points of blocks, and the script of each from there on (0: other).
SCRIPT_STARTS = (0x0, 0x41, 0x2B0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0x980, 0xA00, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB1D, 0xFB50, 0xFE00, 0xFF21, 0xFF66, 0x20000)
SCRIPT_OF = (0, 1, 0, 2, 3, 4, 5, 6, 0, 7, 8, 0, 9, 0, 10, 11, 0, 1, 2, 0, 12, 12, 0, 13, 0, 11, 0, 13, 1, 5, 6, 0, 1, 12, 13)
SCRIPTS = max(SCRIPT_OF) + 1

_LETTER: list[np.ndarray] = []


def letters(cp: np.ndarray) -> np.ndarray:
    """True for code points that are letters; the table is made once in each process."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0][cp]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def trigrams(cp: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """A bucket for each letter: of it and its neighbours, where anything but a letter is one edge sign."""
    c = np.where(letter, cp, 0).astype(np.uint64)
    left, right = np.concatenate(([0], c[:-1])).astype(np.uint64), np.concatenate((c[1:], [0])).astype(np.uint64)
    h = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (c * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (right * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64)[letter] % BUCKETS


@dataclass(frozen=True)
class Model:
    """Languages in order, log likelihoods (language, bucket), and which scripts (language, script) each is written in."""

    languages: tuple[str, ...]
    weights: np.ndarray
    written: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled documents that aren't held out; a language has about `sample` of them.

    Rows are chosen by the hash of id and text against each language's own share, so nothing is sorted or
    gathered; executors count trigrams, and the driver gets sums of at most buckets x languages.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = tuple(sorted(sizes))
    if not names:
        return Model((), np.zeros((0, BUCKETS)), np.zeros((0, SCRIPTS), bool))
    share = F.coalesce(*[F.when(F.col("lang") == name, min(1.0, sample / n)) for name, n in sorted(sizes.items())])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    place = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = {}, {}
        for b in batches:
            for name, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                cp = code_points(text.as_py())
                letter = letters(cp)
                at = place[name]
                grams[at] = grams.get(at, 0) + np.bincount(trigrams(cp, letter), minlength=BUCKETS)
                scripts[at] = scripts.get(at, 0) + np.bincount(script_of(cp[letter]), minlength=SCRIPTS)
        for at in grams:
            both = np.concatenate((grams[at], scripts[at]))
            used = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), at, np.int32)), pa.array(used.astype(np.int32)), pa.array(both[used].astype(np.int64))], ["lang", "bucket", "n"])

    counts, written = np.zeros((len(names), BUCKETS)), np.zeros((len(names), SCRIPTS))
    for r in chosen.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        (counts if r.bucket < BUCKETS else written)[r.lang, r.bucket % BUCKETS] = r.n
    weights = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS))
    weights -= weights.max(0)  # only differences count
    return Model(names, weights, written >= SCRIPT_SHARE * np.maximum(1, written.sum(1, keepdims=True)))


def script_of(cp: np.ndarray) -> np.ndarray:
    return np.asarray(SCRIPT_OF)[np.searchsorted(np.asarray(SCRIPT_STARTS), cp, side="right") - 1]


def words(text: str, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First code point, number of letters, and scores (word, language) of each word: a run of letters."""
    starts, lengths, scores = [], [], []
    cp, at = code_points(text), 0
    while at < len(cp):
        end = min(len(cp), at + CHUNK)
        letter = letters(cp[at : end + 1])
        if end < len(cp) and letter[-1]:  # a word that goes on is left to the next chunk, unless it fills this one
            gap = np.flatnonzero(~letter)
            end = at + int(gap[-1]) + 1 if len(gap) else end
        part, letter = cp[at:end], letter[: end - at]
        edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        if len(edges):
            first, n = edges[::2], edges[1::2] - edges[::2]
            grams, cuts = trigrams(part, letter), np.concatenate(([0], np.cumsum(n)[:-1]))
            score = np.stack([np.add.reduceat(w[grams], cuts) for w in model.weights], 1)
            fits = model.written[:, script_of(part[first])].T
            score -= FOREIGN * (~fits & fits.any(1, keepdims=True))
            starts.append(first + at)
            lengths.append(n)
            scores.append(score)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(model.languages)))
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(scores)


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best path of each document; all documents advance word by word together."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    k = scores[0].shape[1] if scores else 0
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # documents that have a word number t
    offsets = np.concatenate(([0], np.cumsum(active)))
    laid = np.empty((int(offsets[-1]), k))
    base = offsets[:-1]
    for rank, i in enumerate(order):
        laid[base[: len(scores[i])] + rank] = scores[i]
    kind = np.min_scalar_type(-max(k, 1))
    back = np.empty(laid.shape, kind)
    best, here = np.zeros((len(order), k)), np.arange(k, dtype=kind)
    for t in range(steps):
        n = active[t]
        now = best[:n]
        top = now.argmax(1)
        jump = now[np.arange(n), top][:, None] - switch
        stay = now >= jump
        back[base[t] : base[t] + n] = np.where(stay, here, top[:, None])
        best[:n] = np.where(stay, now, jump) + laid[base[t] : base[t] + n]
    paths = [np.empty(len(scores[i]), kind) for i in range(len(scores))]
    state = best.argmax(1)
    flat = np.empty(len(laid), kind)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        flat[base[t] : base[t] + n] = state[:n]
        state[:n] = back[base[t] : base[t] + n][np.arange(n), state[:n]]
    for rank, i in enumerate(order):
        paths[i] = flat[base[: len(scores[i])] + rank]
    return paths


def spans(first: np.ndarray, length: np.ndarray, path: np.ndarray, languages: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """(start, end, language) in code points of the lower-cased text, from a span's first word to its last."""
    if not len(path):
        return []
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [len(path)]))
    return [(int(first[a]), int(first[b - 1] + length[b - 1]), languages[path[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


#: Words whose paths are found together.
TOGETHER = 1 << 20


def label(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """docs with lang_pred, score, and on demand lang_spans array<struct<start,end,lang>>.

    score is the share of letters in words labelled lang_pred; ties go to the first language in order.
    A null text, or one without letters, is `und` with score 0, and so is every text if nothing was
    learnt. Rows that repeat are labelled each; no rows give no rows. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "lang_spans")]
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def flush(texts: list, m: Model) -> list[tuple]:
        found = [words(t, m) if t and m.languages else None for t in texts]
        some = [i for i, f in enumerate(found) if f is not None and len(f[0])]
        out: list[tuple] = [("und", 0.0, [])] * len(texts)
        for i, path in zip(some, viterbi([found[i][2] for i in some]) if some else [], strict=True):
            share = np.bincount(path, weights=found[i][1], minlength=len(m.languages))
            at = int(share.argmax())
            out[i] = (m.languages[at], float(share[at] / share.sum()), spans(found[i][0], found[i][1], path, m.languages) if with_spans else [])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            out, texts, size = [], [], 0
            for t in b.column("text"):
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= 6 * TOGETHER:
                    out += flush(texts, m)
                    texts, size = [], 0
            out += flush(texts, m)
            arrays = [b.column(c) for c in kept] + [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            if with_spans:
                arrays.append(pa.array([[{"start": s, "end": e, "lang": g} for s, e, g in x[2]] for x in out], span_type))
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = kept + ["lang_pred", "score"] + ["lang_spans"] * with_spans
    schema = T.StructType([*docs.select(*kept).schema.fields]).add("lang_pred", "string").add("score", "double")
    if with_spans:
        schema = schema.add("lang_spans", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("lang", "string")))
    return docs.select(*kept).mapInArrow(run, schema)
