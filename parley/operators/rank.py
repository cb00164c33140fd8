"""Graphs and ranks over sentences and tokens: co-occurrence, TextRank, keywords, summaries, topics.

sentences: meeting_id, sent_idx, tokens array<string>, and text where it is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import is_content, trim
from ..session import stage


#: Rounds of joins that one plan holds.
LINEAGE = 5
#: Pairs of sentences and words that are looked at together, about.
PAIRS = 1 << 18


def token_rows(sentences: DataFrame) -> DataFrame:
    return sentences.select("meeting_id", "sent_idx", F.posexplode("tokens").alias("tok_idx", "word"))


def keyword_tokens(sentences: DataFrame, stopwords: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Tokens that may be keywords, numbered anew in each sentence."""
    rows = token_rows(sentences).where((F.length("word") >= config.min_word_chars) & is_content(F.col("word")))
    if stopwords is not None:
        rows = rows.join(stopwords.select("word"), "word", "left_anti")
    order = F.row_number().over(W.partitionBy("meeting_id", "sent_idx").orderBy("tok_idx")) - 1
    return rows.withColumn("tok_idx", order)


def cooccurrence(tokens: DataFrame, window: int = DEFAULT.window) -> DataFrame:
    """meeting_id, src, dst, w: how often two different words lie within `window` tokens of a sentence.

    The band is a chain of leads within the sentence: one pass over each sentence, no join.
    """
    by = W.partitionBy("meeting_id", "sent_idx").orderBy("tok_idx")
    ahead = F.array(*[F.lead("word", k).over(by) for k in range(1, window + 1)])
    pairs = tokens.withColumn("ahead", ahead).select("meeting_id", "word", F.explode("ahead").alias("other")).where("other is not null and other <> word")
    return pairs.groupBy("meeting_id", F.least("word", "other").alias("src"), F.greatest("word", "other").alias("dst")).agg(F.count("*").cast("double").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    good = edges.where("w > 0 and src <> dst")
    return good.select("meeting_id", "src", "dst", "w").unionByName(good.select("meeting_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def out_weight(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("meeting_id", "src").agg(F.sum("w").alias("out_w"))


def textrank_fixed(nodes: DataFrame, edges: DataFrame, rounds: int, config: Config = DEFAULT) -> DataFrame:
    """meeting_id, node, score after a fixed number of rounds, by joins: for graphs of any size.

    Nodes and links are computed once; scores become a table each LINEAGE rounds.
    """
    nodes, links = stage(nodes.select("meeting_id", "node")), stage(both_ways(stage(edges)))
    links = stage(links.join(links.groupBy("meeting_id", "src").agg(F.sum("w").alias("out_w")), ["meeting_id", "src"]).withColumn("p", F.col("w") / F.col("out_w")).select("meeting_id", "src", "dst", "p"))
    scores = nodes.select("meeting_id", "node", F.lit(1.0).alias("score"))
    for done in range(rounds):
        scores = stage(scores) if done and done % LINEAGE == 0 else scores
        given = links.join(scores.withColumnRenamed("node", "src"), ["meeting_id", "src"]).groupBy("meeting_id", F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("score")).alias("got"))
        scores = nodes.join(given, ["meeting_id", "node"], "left").select("meeting_id", "node", (1 - config.damping + config.damping * F.coalesce("got", F.lit(0.0))).alias("score"))
    return scores


def rank_scores(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, config: Config = DEFAULT) -> np.ndarray:
    """TextRank to convergence of nodes 0 to n - 1 over edges (a, b, w), summed in their order, so that scores are the same each time.

    Edges of a negative end, loops and those without weight don't count.
    """
    good = (w > 0) & (a != b) & (a >= 0) & (b >= 0)
    ends = np.column_stack((a[good], b[good])).astype(np.int64)
    src, dst, w = ends.ravel(), ends[:, ::-1].ravel(), np.repeat(w[good], 2)
    share, score = w / np.bincount(src, w, n)[src], np.ones(n)
    for _ in range(config.max_iterations):
        new = 1 - config.damping + config.damping * np.bincount(dst, share * score[src], n)
        moved, score = np.abs(new - score).sum(), new
        if moved < config.epsilon:
            break
    return score


def rank_graph(names: list, edges: list[tuple], config: Config = DEFAULT) -> dict:
    """rank_scores of named nodes and (a, b, w) edges."""
    place = {x: i for i, x in enumerate(names)}
    a, b = (np.array([place.get(e[k], -1) for e in edges], np.int64) for k in (0, 1))
    return dict(zip(names, rank_scores(len(names), a, b, np.array([e[2] for e in edges], float), config).tolist(), strict=True))


def gathered(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """One row a meeting with all of its rows as an array of structs, in order."""
    return rows.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def textrank(edges: DataFrame, nodes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """meeting_id, node, score to convergence, one meeting's graph at a time."""
    each = gathered(nodes, "nodes", "node").join(gathered(edges, "edges", "src", "dst", "w"), "meeting_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, links = batch.column("nodes")[i].values.field("node"), batch.column("edges")[i].values
                a, b, w = (links.field(c) for c in ("src", "dst", "w")) if links is not None else (names[:0], names[:0], pa.array([], pa.float64()))
                a, b = (np.asarray(pc.fill_null(pc.index_in(x, value_set=names), -1)) for x in (a, b))
                meeting = batch.column("meeting_id").take(pa.array(np.full(len(names), i)))
                yield pa.RecordBatch.from_arrays([meeting, names, pa.array(rank_scores(len(names), a, b, np.asarray(w), config))], ["meeting_id", "node", "score"])

    schema = f"meeting_id {nodes.schema['meeting_id'].dataType.simpleString()}, node {nodes.schema['node'].dataType.simpleString()}, score double"
    return each.mapInArrow(run, schema)


def min_max(rows: DataFrame, value: str, key: str = "meeting_id") -> DataFrame:
    """value scaled to 0..1 within its key; 0.5 where all are equal."""
    by = W.partitionBy(key)
    low, high = F.min(value).over(by), F.max(value).over(by)
    return rows.withColumn("__low", low).withColumn("__span", high - low).withColumn(value, F.when(F.col("__span") <= 1e-12, 0.5).otherwise((F.col(value) - F.col("__low")) / F.col("__span"))).drop("__low", "__span")


def tf_idf(tf: Column, n_words: Column, probability: Column) -> Column:
    """tf * ln(1 + N / (1 + p)), p being the word's probability in the lexicon, 0 if unknown."""
    return tf * F.log(1 + n_words / (1 + F.coalesce(probability, F.lit(0.0))))


def keywords(sentences: DataFrame, stopwords: DataFrame | None = None, lexicon: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """meeting_id, rank, word, score, text_rank, tfidf, frequency: the best words of each meeting."""
    tokens = keyword_tokens(sentences, stopwords, config)
    counts = tokens.groupBy("meeting_id", "word").agg(F.count("*").alias("frequency"))
    ranks = textrank(cooccurrence(tokens, config.window), counts.select("meeting_id", F.col("word").alias("node")), config)
    rows = counts.join(ranks.withColumnRenamed("node", "word"), ["meeting_id", "word"])
    rows = rows.join(lexicon.select("word", F.exp("log_prob").alias("p")), "word", "left") if lexicon is not None else rows.withColumn("p", F.lit(0.0))
    rows = rows.withColumn("tfidf", tf_idf(F.col("frequency"), F.sum("frequency").over(W.partitionBy("meeting_id")), F.col("p")))
    rows = min_max(min_max(rows.withColumn("text_rank", F.col("score")), "text_rank"), "tfidf")
    score = config.alpha * F.col("text_rank") + (1 - config.alpha) * F.col("tfidf")
    score = score * F.when(F.length("word") >= 3, 1.05).otherwise(1.0) * F.when(F.col("frequency") >= 3, 1.03).otherwise(1.0)
    rows = rows.withColumn("score", score)
    order = W.partitionBy("meeting_id").orderBy(F.round("score", 9).desc(), F.col("frequency").desc(), "word")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_keywords).select("meeting_id", "rank", "word", "score", "text_rank", "tfidf", "frequency")


def similarity(a: Column, b: Column) -> Column:
    """Distinct words in common over the logs of both lengths."""
    size = F.log(F.size(a) + 1) + F.log(F.size(b) + 1)
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (size > 0), F.size(F.array_intersect(a, b)) / size).otherwise(0.0)


def sentence_edges(sentences: DataFrame) -> DataFrame:
    """meeting_id, src, dst, w for sentences that share a word: an equi-join on words, not on all pairs."""
    sized = sentences.select("meeting_id", "sent_idx", F.size("tokens").alias("n"), F.explode(F.array_distinct("tokens")).alias("word"))
    other = sized.select("meeting_id", "word", F.col("sent_idx").alias("dst"), F.col("n").alias("m"))
    pairs = sized.join(other, ["meeting_id", "word"]).where("sent_idx < dst")
    both = pairs.groupBy("meeting_id", F.col("sent_idx").alias("src"), "dst").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    return both.select("meeting_id", "src", "dst", (F.col("c") / (F.log(F.col("n") + 1) + F.log(F.col("m") + 1))).alias("w"))


def shared_words(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, w of the sentences a < b of one meeting that share a word, in order: what sentence_edges says, without a row a word and pair."""
    n, words = len(tokens), pc.dictionary_encode(tokens.flatten()).indices
    many = np.log(np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)) + 1.0)
    known = np.asarray(pc.is_valid(words))
    word, owner = np.asarray(words.fill_null(0))[known].astype(np.int64), np.asarray(pc.list_parent_indices(tokens))[known].astype(np.int64)
    held = np.unique(owner * (len(word) + 1) + word)
    owner, word = held // (len(word) + 1), held % (len(word) + 1)
    by = np.argsort(word, kind="stable")
    place = np.empty_like(by)
    place[by] = np.arange(len(by))
    later = np.searchsorted(word[by], word, side="right") - place - 1  # sentences after this one with this word
    total, found, start = np.concatenate(([0], np.cumsum(later))), [], 0
    while start < len(owner):  # some sentences at a time, each whole
        end = int(np.searchsorted(owner, owner[max(start, int(np.searchsorted(total, total[start] + PAIRS, side="right")) - 2)], side="right"))
        k = later[start:end]
        at = np.arange(k.sum()) + np.repeat(place[start:end] + 1 - (total[start:end] - total[start]), k)
        pairs, common = np.unique(np.repeat(owner[start:end], k) * n + owner[by][at], return_counts=True)
        found.append((pairs, common))
        start = end
    pairs, common = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0))
    a, b = pairs // max(1, n), pairs % max(1, n)
    return a, b, common / (many[a] + many[b])


def pick(importance: list[float], similar: dict[tuple[int, int], float], k: int, weight: float) -> list[int]:
    """Indices by maximal marginal relevance, in their order; the earlier one of equals."""
    nearest, chosen, rest = [0.0] * len(importance), [], list(range(len(importance)))
    while rest and len(chosen) < k:
        best = rest[0]
        for i in rest[1:]:
            if weight * importance[i] - (1 - weight) * nearest[i] > weight * importance[best] - (1 - weight) * nearest[best] + 1e-12:
                best = i
        rest.remove(best)
        chosen.append(best)
        for i in rest:
            nearest[i] = max(nearest[i], similar.get((min(i, best), max(i, best)), 0.0))
    return sorted(chosen)


def summary(sentences: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """meeting_id, sent_idx, text, score, in_overview: key sentences of each meeting, of repeated ones the first.

    A meeting's sentences form one group: a meeting, however long, not the corpus.
    """
    w = W.partitionBy("meeting_id", "__t").orderBy("sent_idx")
    rows = sentences.withColumn("__t", trim(F.col("text"))).where("__t <> ''").withColumn("__r", F.row_number().over(w)).where("__r = 1").select("meeting_id", "sent_idx", "text", "tokens")

    each = gathered(rows, "sents", "sent_idx", "text", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in range(batch.num_rows):
                sents = batch.column("sents")[m].values
                n, (a, b, w) = len(sents), shared_words(sents.field("tokens"))
                score = rank_scores(n, a, b, w, config).tolist()
                low, high = min(score, default=0.0), max(score, default=0.0)
                level = [0.5 if high - low <= 1e-12 else (x - low) / (high - low) for x in score]
                most = min(n, max(config.summary_min, min(config.summary_max, math.ceil(n * config.summary_ratio))))
                chosen = list(range(n)) if n <= config.summary_min else pick(level, dict(zip(zip(a.tolist(), b.tolist()), w.tolist())), most, config.summary_lambda)
                top = set(sorted(chosen, key=lambda i: (-level[i], i))[: config.overview_sentences])
                at = pa.array(chosen, pa.int32())
                meeting = batch.column("meeting_id").take(pa.array(np.full(len(chosen), m)))
                yield pa.RecordBatch.from_arrays([meeting, sents.field("sent_idx").take(at).cast(pa.int32()), sents.field("text").take(at), pa.array([level[i] for i in chosen], pa.float64()), pa.array([i in top for i in chosen], pa.bool_())], ["meeting_id", "sent_idx", "text", "score", "in_overview"])

    kind = sentences.schema["meeting_id"].dataType.simpleString()
    return each.mapInArrow(run, f"meeting_id {kind}, sent_idx int, text string, score double, in_overview boolean")


def block_cosine(sentences: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """meeting_id, block, sim: cosine of the word counts of each block of sentences and the next."""
    rows = sentences.withColumn("block", F.floor(F.col("sent_idx") / config.topic_block).cast("int"))
    counts = rows.select("meeting_id", "block", F.explode("tokens").alias("word")).groupBy("meeting_id", "block", "word").agg(F.count("*").cast("double").alias("n"))
    norms = counts.groupBy("meeting_id", "block").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    nxt = counts.select("meeting_id", (F.col("block") - 1).alias("block"), "word", F.col("n").alias("m"))
    dots = counts.join(nxt, ["meeting_id", "block", "word"]).groupBy("meeting_id", "block").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    size = sentences.groupBy("meeting_id").agg(F.count("*").alias("n"))
    all_blocks = size.where(F.col("n") >= 2 * config.topic_block).select("meeting_id", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / config.topic_block) - 2).cast("int"))).alias("block"))
    out = all_blocks.join(dots, ["meeting_id", "block"], "left").join(norms, ["meeting_id", "block"], "left").join(norms.select("meeting_id", (F.col("block") - 1).alias("block"), F.col("norm").alias("after")), ["meeting_id", "block"], "left")
    return out.select("meeting_id", "block", F.coalesce(F.col("dot") / (F.col("norm") * F.col("after")), F.lit(0.0)).alias("sim"))


def valleys(sims: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Blocks after which a topic may end: well below the mean and no higher than both neighbours."""
    by, w = W.partitionBy("meeting_id"), W.partitionBy("meeting_id").orderBy("block")
    low = F.col("sim") < F.avg("sim").over(by) - config.topic_sigma * F.stddev_pop("sim").over(by)
    least = F.coalesce(F.col("sim") <= F.lag("sim").over(w), F.lit(True)) & F.coalesce(F.col("sim") <= F.lead("sim").over(w), F.lit(True))
    return sims.withColumn("__v", low & least & (F.count("*").over(by) >= 2)).where("__v").drop("__v")


def topics(sentences: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """meeting_id, topic_idx, start_sentence, end_sentence, keywords, title: contiguous topics over all sentences.

    Boundaries follow valleys; one that would close a topic too soon after the last kept is dropped.
    """
    size = sentences.groupBy("meeting_id").agg(F.count("*").cast("int").alias("n"))
    cuts = valleys(block_cosine(sentences, config), config).select("meeting_id", ((F.col("block") + 1) * config.topic_block).cast("int").alias("cut")).groupBy("meeting_id").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    rows = size.join(cuts, "meeting_id", "left").withColumn("cuts", F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda c: c < F.col("n")))
    kept = F.aggregate("cuts", F.array(F.lit(0)), lambda acc, c: F.when(c - F.element_at(acc, -1) >= config.topic_min_sentences, F.concat(acc, F.array(c))).otherwise(acc))
    rows = rows.withColumn("starts", kept).withColumn("ends", F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array("n")))
    spans = rows.select("meeting_id", F.posexplode(F.arrays_zip("starts", "ends")).alias("topic_idx", "x")).where(F.col("topic_idx") < config.max_topics)
    spans = spans.select("meeting_id", "topic_idx", F.col("x.starts").alias("start_sentence"), F.col("x.ends").alias("end_sentence"))
    inside = sentences.join(spans, "meeting_id").where("sent_idx >= start_sentence and sent_idx < end_sentence")
    keyed = inside.select(F.struct("meeting_id", "topic_idx").alias("meeting_id"), "sent_idx", "tokens")
    words = token_rows(keyed)
    ranked = textrank_topics(words, config)
    order = W.partitionBy("meeting_id", "topic_idx").orderBy(F.round("score", 9).desc(), "node")
    best = ranked.where(F.length("node") >= 2).withColumn("__r", F.row_number().over(order)).where("__r <= 3").groupBy("meeting_id", "topic_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "node"))), lambda x: x["node"]).alias("keywords"))
    out = spans.join(best, ["meeting_id", "topic_idx"], "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    alone = F.when(F.count("*").over(W.partitionBy("meeting_id")) == 1, "会议内容").otherwise(F.concat(F.lit("议题 "), (F.col("topic_idx") + 1).cast("string")))
    return out.withColumn("title", F.when(F.size("keywords") > 0, F.array_join("keywords", " / ")).otherwise(alone))


def textrank_topics(words: DataFrame, config: Config) -> DataFrame:
    """meeting_id, topic_idx, node, score: TextRank within each topic."""
    text = F.to_json(F.struct(F.col("meeting_id.meeting_id").alias("m"), F.col("meeting_id.topic_idx").alias("t")))
    flat = words.withColumn("meeting_id", text)
    ranked = textrank(cooccurrence(flat, config.window), flat.select("meeting_id", F.col("word").alias("node")).distinct(), config)
    kind = words.schema["meeting_id"].dataType["meeting_id"].dataType.simpleString()
    key = F.from_json("meeting_id", f"m {kind}, t int")
    return ranked.withColumn("__k", key).select(F.col("__k.m").alias("meeting_id"), F.col("__k.t").alias("topic_idx"), "node", "score")
