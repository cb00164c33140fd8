"""Registered queries of the engine's operators over the driver tables, each with its SQL where SQL can say it.

Stand-ins: a conversation is a meeting and its turns are segments (3.5 s apart, 3 s long, one speaker a
role); a user's events are frames or segments in time order; embeddings are voices or samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import chinese, signal, text as tx, vectors
from ..functions import words as w
from ..operators import extract, rank, speech, timeline as tl
from ..sources import sinks, tables
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
SENTENCE_RE = "[^。！？!?.；;…\n]*[。！？!?.；;…][”）\"'']*|[^。！？!?.；;…\n]+"
PIECES = f"list_filter(list_transform(regexp_extract_all(text, '{SENTENCE_RE}'), lambda s: trim(s, {SPACES})), lambda s: s <> '')"
TOKENS = "regexp_extract_all(text, '[A-Za-z0-9._+#%/@-]*[A-Za-z0-9%]|[._+#/@-]')"
STOP = ("the", "and", "of", "to", "in", "is", "that", "it", "was", "for", "on", "as", "with", "at", "by", "an", "be", "this", "from", "or", "are")
STOP_SQL = ", ".join(f"('{x}')" for x in STOP)


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column, places: int) -> Column:
    """x to `places` decimals as the SQL rounds: what is scaled and rounded is the double, not its shortest decimals, which may lie below a tie that the double meets."""
    return F.round(x * 10.0**places) / 10.0**places


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    speaker = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), turn.cast("int").alias("seg_idx"), (turn * 3500).alias("start_ms"), (turn * 3500 + 3000).alias("end_ms"), speaker.alias("speaker_id"), F.coalesce("role", F.lit("")).alias("label"), F.coalesce("text", F.lit("")).alias("text"))


SEGMENTS = """seg AS (SELECT conv_id AS meeting_id, CAST(turn AS INTEGER) AS seg_idx, turn * 3500 AS start_ms, turn * 3500 + 3000 AS end_ms,
    CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS speaker_id, coalesce(role, '') AS label, coalesce(text, '') AS text FROM conversations)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a sentence with its tokens."""
    return segments(spark, sf_dir).select("meeting_id", F.col("seg_idx").alias("sent_idx"), "text", tx.ascii_tokens(F.col("text")).alias("tokens"))


def stop_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in STOP], "word string")


TOKEN_ROWS = f"{SEGMENTS}, sent AS (SELECT meeting_id, seg_idx AS sent_idx, {TOKENS} AS tokens FROM seg), tok AS (SELECT meeting_id, sent_idx, unnest(tokens) AS word, generate_subscripts(tokens, 1) - 1 AS tok_idx FROM sent)"
KEYWORD_ROWS = f"{TOKEN_ROWS}, kw AS (SELECT meeting_id, sent_idx, word, row_number() OVER (PARTITION BY meeting_id, sent_idx ORDER BY tok_idx) - 1 AS tok_idx FROM tok WHERE length(word) >= 2 AND regexp_matches(word, '[A-Za-z0-9]') AND NOT regexp_matches(word, '^[0-9.]+$') AND word NOT IN (SELECT * FROM (VALUES {STOP_SQL})))"
EDGES = f"{KEYWORD_ROWS}, edge AS (SELECT a.meeting_id, least(a.word, b.word) AS src, greatest(a.word, b.word) AS dst, CAST(count(*) AS DOUBLE) AS w FROM kw a JOIN kw b ON a.meeting_id = b.meeting_id AND a.sent_idx = b.sent_idx AND b.tok_idx > a.tok_idx AND b.tok_idx <= a.tok_idx + 5 AND a.word <> b.word GROUP BY ALL)"


def keyword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.keyword_tokens(tokens(spark, sf_dir), stop_words(spark))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.cooccurrence(keyword_tokens(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id (the user), frame_idx in time order, start_ms, end_ms (start plus value seconds), value, event_type."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    order = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    start = F.floor(us / 1000).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("meeting_id"), order.cast("int").alias("frame_idx"), start.alias("start_ms"), (start + F.round(F.col("value") * 1000).cast("long")).alias("end_ms"), "value", "event_type")


EVENTS = """ev AS (SELECT user_id AS meeting_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS start_ms, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 + CAST(round(value * 1000) AS BIGINT) AS end_ms, value, event_type FROM events)"""


# ---- text


@query(f"WITH p AS (SELECT doc_id, {PIECES} AS p FROM documents) SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS sent_idx, unnest(p) AS sentence FROM p")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent_idx", "sentence"))


@query(f"""WITH {SEGMENTS}, p AS (SELECT *, {PIECES} AS p FROM seg),
    e AS (SELECT meeting_id, seg_idx, start_ms, end_ms, generate_subscripts(p, 1) AS k, unnest(p) AS piece FROM p),
    t AS (SELECT *, (end_ms - start_ms) * length(piece) // greatest(sum(length(piece)) OVER (PARTITION BY meeting_id, seg_idx), 1) AS ms FROM e),
    c AS (SELECT *, least(start_ms + sum(ms) OVER (PARTITION BY meeting_id, seg_idx ORDER BY k), end_ms) AS piece_end FROM t)
    SELECT meeting_id, seg_idx, CAST(k - 1 AS INTEGER) AS k, piece, CAST(coalesce(lag(piece_end) OVER (PARTITION BY meeting_id, seg_idx ORDER BY k), start_ms) AS BIGINT) AS piece_start, CAST(piece_end AS BIGINT) AS piece_end FROM c""")
def sentence_times(spark, sf_dir):
    rows = segments(spark, sf_dir).select("meeting_id", "seg_idx", "start_ms", "end_ms", F.posexplode(tx.sentences(F.col("text"))).alias("k", "piece"))
    return tl.share_time(rows.withColumn("n", F.length("piece")), ["meeting_id", "seg_idx"], "k", "n").select("meeting_id", "seg_idx", "k", "piece", "piece_start", "piece_end")


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS INTEGER) AS n_tokens, md5(array_to_string({TOKENS}, ' ')) AS digest FROM documents")
def tokenize_ascii(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", tx.ascii_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(f"WITH t AS (SELECT unnest({TOKENS}) AS word FROM documents) SELECT word, count(*) AS n FROM t WHERE length(word) >= 2 AND regexp_matches(word, '[A-Za-z0-9]') AND NOT regexp_matches(word, '^[0-9.]+$') AND word NOT IN (SELECT * FROM (VALUES {STOP_SQL})) GROUP BY word")
def content_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(tx.ascii_tokens(F.col("text"))).alias("word")).where((F.length("word") >= 2) & tx.is_content(F.col("word")))
    return rows.join(F.broadcast(stop_words(spark)), "word", "left_anti").groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, len({PIECES}) > 0 AND ({PIECES})[len({PIECES})] <> '' AS has_text, length(regexp_replace(text, '[^。！？!?.；;…]', '', 'g')) AS n_ends, regexp_matches(trim(text, {SPACES}), '[？?]$') AS question FROM documents")
def text_marks(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (F.size(tx.sentences(text)) > 0).alias("has_text"), F.length(F.regexp_replace(text, "[^。！？!?.；;…]", "")).cast("long").alias("n_ends"), tx.is_question(text).alias("question"))


@query(f"SELECT doc_id, translate(text, '{w.HALF_WIDTH[1:].replace(chr(39), chr(39) * 2)}', '{w.FULL_WIDTH[1:]}') = text AS same, md5(text) AS half FROM documents")
def fullwidth_to_halfwidth(spark, sf_dir):
    wide = F.translate("text", w.HALF_WIDTH[1:], w.FULL_WIDTH[1:])
    return table(spark, sf_dir, "documents").select("doc_id", (wide == F.col("text")).alias("same"), F.md5(tx.half_width(wide).cast("binary")).alias("half"))


@query("""WITH n AS (SELECT page_id, trim(regexp_replace(url, '[/\\\\:*?"<>|]', '_', 'g')) AS s FROM pages) SELECT page_id, CASE WHEN rtrim(s, '.') = '' THEN 'untitled' ELSE ltrim(rtrim(s, '.'), '.') END AS name FROM n""")
def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query(f"WITH {EVENTS} SELECT meeting_id, frame_idx, printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) AS hms, printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS srt, printf('%02d:%02d', start_ms // 60000, start_ms // 1000 % 60) AS short FROM ev")
def format_duration(spark, sf_dir):
    ms = F.col("start_ms")
    return events(spark, sf_dir).select("meeting_id", "frame_idx", tx.duration(ms).alias("hms"), tx.srt_time(ms).alias("srt"), tx.short_time(ms).alias("short"))


@query("SELECT o_orderkey, o_orderdate, CAST(isodow(o_orderdate) AS INTEGER) AS weekday, CAST(last_day(o_orderdate) AS DATE) AS month_end FROM orders")
def date_parts(spark, sf_dir):
    d = tx.parse_date(F.date_format("o_orderdate", "yyyy/M/d"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate"), tx.weekday(d).cast("int").alias("weekday"), F.last_day(d).alias("month_end"))


@query(f"WITH {SEGMENTS} SELECT meeting_id, CASE WHEN length(trim(regexp_replace(({PIECES})[1], '[。！？!?.；;…]', '', 'g'), {SPACES})) >= 4 THEN left(trim(regexp_replace(({PIECES})[1], '[。！？!?.；;…]', '', 'g'), {SPACES}), 24) ELSE '会议纪要' END AS title FROM seg WHERE seg_idx = 0")
def derive_title(spark, sf_dir):
    return segments(spark, sf_dir).where("seg_idx = 0").select("meeting_id", tx.title(F.col("text"), F.lit("会议纪要")).alias("title"))


# ---- counts and graphs


@query(f"WITH {TOKEN_ROWS} SELECT meeting_id, word, count(*) AS frequency FROM tok GROUP BY ALL")
def term_frequency(spark, sf_dir):
    return rank.token_rows(tokens(spark, sf_dir)).groupBy("meeting_id", "word").agg(F.count("*").alias("frequency"))


@query(f"WITH {KEYWORD_ROWS}, c AS (SELECT meeting_id, word, count(*) AS n FROM kw GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY n DESC, word) AS rank FROM c) SELECT meeting_id, CAST(rank AS INTEGER) AS rank, word, n FROM r WHERE rank <= 12")
def keyword_topk_tf(spark, sf_dir):
    counts = keyword_tokens(spark, sf_dir).groupBy("meeting_id", "word").agg(F.count("*").alias("n"))
    order = W.partitionBy("meeting_id").orderBy(F.col("n").desc(), "word")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DEFAULT.top_keywords).select("meeting_id", "rank", "word", "n")


@query(f"WITH {KEYWORD_ROWS}, c AS (SELECT meeting_id, word, count(*) AS n FROM kw GROUP BY ALL) SELECT meeting_id, word, n, round(n * ln(1 + sum(n) OVER (PARTITION BY meeting_id) / 1.0), 6) AS tfidf FROM c")
def tfidf_const_idf(spark, sf_dir):
    counts = keyword_tokens(spark, sf_dir).groupBy("meeting_id", "word").agg(F.count("*").alias("n"))
    score = rank.tf_idf(F.col("n"), F.sum("n").over(W.partitionBy("meeting_id")), F.lit(0.0))
    return counts.select("meeting_id", "word", "n", F.round(score, 6).alias("tfidf"))


@query(f"WITH {EDGES} SELECT * FROM edge")
def cooccurrence_window5(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"WITH {EDGES}, ends AS (SELECT meeting_id, src, w FROM edge UNION ALL SELECT meeting_id, dst, w FROM edge) SELECT meeting_id, src, sum(w) AS out_w FROM ends GROUP BY ALL")
def node_out_weight(spark, sf_dir):
    return rank.out_weight(edges(spark, sf_dir))


def _textrank_sql(rounds: int) -> str:
    parts = [EDGES, "link AS (SELECT meeting_id, src, dst, w FROM edge UNION ALL SELECT meeting_id, dst, src, w FROM edge)", "p AS (SELECT meeting_id, src, dst, w / sum(w) OVER (PARTITION BY meeting_id, src) AS p FROM link)", "node AS (SELECT DISTINCT meeting_id, word AS node FROM kw)", "s0 AS (SELECT meeting_id, node, 1.0::DOUBLE AS score FROM node)"]
    for i in range(rounds):
        parts.append(f"s{i + 1} AS (SELECT n.meeting_id, n.node, 0.15 + 0.85 * coalesce(g.got, 0) AS score FROM node n LEFT JOIN (SELECT p.meeting_id, p.dst AS node, sum(p.p * s.score) AS got FROM p JOIN s{i} s ON s.meeting_id = p.meeting_id AND s.node = p.src GROUP BY ALL) g ON g.meeting_id = n.meeting_id AND g.node = n.node)")
    return f"WITH {', '.join(parts)} SELECT meeting_id, node, round(score, 10) AS score FROM s{rounds}"


@query(_textrank_sql(3))
def textrank_words_k(spark, sf_dir):
    nodes = keyword_tokens(spark, sf_dir).select("meeting_id", F.col("word").alias("node")).distinct()
    return rank.textrank_fixed(nodes, edges(spark, sf_dir), 3).withColumn("score", F.round("score", 10))


@query()
def textrank_words(spark, sf_dir):
    nodes = keyword_tokens(spark, sf_dir).select("meeting_id", F.col("word").alias("node")).distinct()
    return rank.textrank(edges(spark, sf_dir), nodes)


@query(f"WITH {TOKEN_ROWS}, d AS (SELECT DISTINCT meeting_id, sent_idx, word FROM tok), n AS (SELECT meeting_id, sent_idx, len(tokens) AS n FROM sent) SELECT a.meeting_id, a.sent_idx AS src, b.sent_idx AS dst, round(count(*) / (ln(any_value(x.n) + 1) + ln(any_value(y.n) + 1)), 6) AS w FROM d a JOIN d b ON a.meeting_id = b.meeting_id AND a.word = b.word AND a.sent_idx < b.sent_idx JOIN n x ON x.meeting_id = a.meeting_id AND x.sent_idx = a.sent_idx JOIN n y ON y.meeting_id = b.meeting_id AND y.sent_idx = b.sent_idx GROUP BY a.meeting_id, a.sent_idx, b.sent_idx")
def sentence_similarity(spark, sf_dir):
    return rank.sentence_edges(tokens(spark, sf_dir)).withColumn("w", F.round("w", 6))


@query(f"WITH {EVENTS}, r AS (SELECT meeting_id, frame_idx, value, min(value) OVER (PARTITION BY meeting_id) AS a, max(value) OVER (PARTITION BY meeting_id) AS b FROM ev) SELECT meeting_id, frame_idx, round(CASE WHEN b - a <= 1e-12 THEN 0.5 ELSE (value - a) / (b - a) END, 6) AS value FROM r")
def minmax_norm(spark, sf_dir):
    return rank.min_max(events(spark, sf_dir).select("meeting_id", "frame_idx", "value"), "value").withColumn("value", F.round("value", 6))


BLOCKS = f"""{TOKEN_ROWS}, c AS (SELECT meeting_id, sent_idx // 2 AS block, word, CAST(count(*) AS DOUBLE) AS n FROM tok GROUP BY ALL),
    norm AS (SELECT meeting_id, block, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL), size AS (SELECT meeting_id, count(*) AS n FROM sent GROUP BY ALL HAVING count(*) >= 4),
    b AS (SELECT meeting_id, unnest(range(0, CAST(ceil(n / 2.0) AS BIGINT) - 1)) AS block FROM size),
    dot AS (SELECT x.meeting_id, x.block, sum(x.n * y.n) AS dot FROM c x JOIN c y ON x.meeting_id = y.meeting_id AND y.block = x.block + 1 AND x.word = y.word GROUP BY ALL),
    sim AS (SELECT b.meeting_id, CAST(b.block AS INTEGER) AS block, coalesce(dot / (p.norm * q.norm), 0.0) AS sim FROM b LEFT JOIN dot ON dot.meeting_id = b.meeting_id AND dot.block = b.block LEFT JOIN norm p ON p.meeting_id = b.meeting_id AND p.block = b.block LEFT JOIN norm q ON q.meeting_id = b.meeting_id AND q.block = b.block + 1)"""


def _two(config=DEFAULT):
    import dataclasses

    return dataclasses.replace(config, topic_block=2, topic_min_sentences=2)


@query(f"WITH {BLOCKS} SELECT meeting_id, block, round(sim, 6) AS sim FROM sim")
def block_cosine(spark, sf_dir):
    return rank.block_cosine(tokens(spark, sf_dir), _two()).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {BLOCKS}, r AS (SELECT meeting_id, block, round(sim, 9) AS sim FROM sim), v AS (SELECT meeting_id, block, sim, avg(sim) OVER m - 0.5 * stddev_pop(sim) OVER m AS low, count(*) OVER m AS n, lag(sim) OVER o AS a, lead(sim) OVER o AS z FROM r WINDOW m AS (PARTITION BY meeting_id), o AS (PARTITION BY meeting_id ORDER BY block))
    SELECT meeting_id, block FROM v WHERE n >= 2 AND sim < low - 1e-9 AND coalesce(sim <= a, true) AND coalesce(sim <= z, true)""")
def topic_valleys(spark, sf_dir):
    sims = rank.block_cosine(tokens(spark, sf_dir), _two()).withColumn("sim", F.round("sim", 9))
    return rank.valleys(sims, _two()).select("meeting_id", "block")


@query()
def topic_segments(spark, sf_dir):
    return rank.topics(tokens(spark, sf_dir), _two())


@query()
def keyword_scores(spark, sf_dir):
    return rank.keywords(tokens(spark, sf_dir), stop_words(spark))


@query()
def mmr_summary(spark, sf_dir):
    return rank.summary(tokens(spark, sf_dir))


# ---- extraction, on fixed sentences and on the tables

SAID = (
    "我们决定采用方案A", "这个方案通过了", "我不同意这个做法", "今天天气不错", "大家一致同意", "能不能通过？", "请尽快处理", "必须今天完成", "有空可以看一下", "周五前提交",
    "这个由李四负责", "请张三跟进一下进度", "让王五来落实这件事", "@赵六 记得提交报告", "产品负责这块", "九月二十日前提交", "下周三之前完成", "明天给我", "10月8日上线", "月底前完成", "3个工作日内反馈",
    "百分之三十的预算", "二零二六年三点五版", "嗯那个我们继续推进", "我来整理会议记录", "这个方案可以吗？",
)


# ---- statistics, transcripts


@query(f"WITH {SEGMENTS} SELECT meeting_id, speaker_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms, count(*) AS n FROM seg GROUP BY ROLLUP (meeting_id, speaker_id)")
def speaker_rollup(spark, sf_dir):
    return segments(spark, sf_dir).rollup("meeting_id", "speaker_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"), F.count("*").alias("n"))


@query(f"WITH {SEGMENTS}, c AS (SELECT *, CASE WHEN lag(speaker_id) OVER o = speaker_id THEN 0 ELSE 1 END AS c FROM seg WINDOW o AS (PARTITION BY meeting_id ORDER BY seg_idx)), g AS (SELECT *, sum(c) OVER (PARTITION BY meeting_id ORDER BY seg_idx) - 1 AS turn_idx FROM c) SELECT meeting_id, CAST(turn_idx AS BIGINT) AS turn_idx, speaker_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_segments FROM g GROUP BY ALL")
def speaker_turns(spark, sf_dir):
    return tl.turns(segments(spark, sf_dir))


@query(f"WITH {SEGMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS n FROM seg WHERE trim(text, {SPACES}) <> '') SELECT meeting_id, CAST(n AS INTEGER) AS n, n || chr(10) || printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || chr(10) || '[' || label || '] ' || trim(text, {SPACES}) || chr(10) AS cue FROM r")
def srt_lines(spark, sf_dir):
    return sinks.srt_lines(segments(spark, sf_dir))


@query(f"WITH {SEGMENTS} SELECT meeting_id, string_agg('[' || printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) || '] ' || label || ': ' || trim(text, {SPACES}), chr(10) ORDER BY seg_idx) AS transcript FROM seg WHERE trim(text, {SPACES}) <> '' GROUP BY meeting_id")
def transcript_text(spark, sf_dir):
    return sinks.joined(sinks.transcript_lines(segments(spark, sf_dir)), "seg_idx", "line", "transcript")


@query(f"WITH {SEGMENTS}, s AS (SELECT meeting_id, count(*) AS n, max(end_ms) AS d FROM seg GROUP BY ALL) SELECT meeting_id, list_filter([CASE WHEN n % 3 > 0 THEN '存在 ' || (n % 3) || ' 个低置信度转写片段，建议人工核对对应时间点' END, CASE WHEN n % 2 > 0 THEN '有 ' || (n % 2) || ' 条待办未指明责任人' END, CASE WHEN n % 5 = 0 THEN '未识别到明确决议，若会议有结论请在纪要中补充' END, CASE WHEN d > 10800000 THEN '会议时长超过 3 小时，建议拆分议题分别归档' END], lambda x: x IS NOT NULL) AS risks FROM s")
def risk_notes(spark, sf_dir):
    s = segments(spark, sf_dir).groupBy("meeting_id").agg(F.count("*").alias("n"), F.max("end_ms").alias("duration_ms"))
    return extract.risks(s.select("meeting_id", (F.col("n") % 3).alias("low_confidence"), (F.col("n") % 2).alias("no_owner"), (F.col("n") % 5).alias("n_decisions"), "duration_ms", F.lit(0.0).alias("speech_ratio")))


@query(f"WITH {SEGMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, text ORDER BY seg_idx) AS r FROM seg) SELECT meeting_id, seg_idx, text FROM r WHERE r = 1")
def dedupe_first(spark, sf_dir):
    return extract.first_of_each(segments(spark, sf_dir), "text", "seg_idx").select("meeting_id", "seg_idx", "text")


@query("WITH r AS (SELECT user_id AS id, event_id AS created_at, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT id, created_at, event_type FROM r WHERE r = 1")
def session_latest(spark, sf_dir):
    return tables.sessions(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("created_at"), "event_type"))


@query(f"WITH {SEGMENTS}, b AS (SELECT *, CASE WHEN seg_idx % 3 = 1 THEN 'merge' WHEN seg_idx % 7 = 6 THEN 'delete' END AS op FROM seg), g AS (SELECT *, sum(CASE WHEN op = 'merge' AND lag(1) OVER o IS NOT NULL THEN 0 ELSE 1 END) OVER o AS g FROM (SELECT * FROM b WHERE op IS DISTINCT FROM 'delete') WINDOW o AS (PARTITION BY meeting_id ORDER BY seg_idx)) SELECT meeting_id, min(seg_idx) AS seg_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(trim(text), '' ORDER BY seg_idx) AS text FROM g GROUP BY meeting_id, g".replace("sum(CASE WHEN op = 'merge' AND lag(1) OVER o IS NOT NULL THEN 0 ELSE 1 END) OVER o", "sum(k) OVER o").replace("(SELECT * FROM b WHERE op IS DISTINCT FROM 'delete')", "(SELECT *, CASE WHEN op = 'merge' AND lag(1) OVER (PARTITION BY meeting_id ORDER BY seg_idx) IS NOT NULL THEN 0 ELSE 1 END AS k FROM b WHERE op IS DISTINCT FROM 'delete')"))
def review_edits(spark, sf_dir):
    rows = segments(spark, sf_dir)
    edits = rows.select("meeting_id", "seg_idx", F.when(F.col("seg_idx") % 3 == 1, "merge").when(F.col("seg_idx") % 7 == 6, "delete").alias("op"), F.lit(None).cast("string").alias("value")).where("op is not null")
    return tl.review(rows, edits).select("meeting_id", "seg_idx", "start_ms", "end_ms", "text")


# ---- timelines


@query(f"WITH {EVENTS} SELECT meeting_id, frame_idx, CASE WHEN lead(start_ms) OVER o IS NOT NULL THEN greatest(lead(start_ms) OVER o - end_ms, 0) END AS gap_ms FROM ev WINDOW o AS (PARTITION BY meeting_id ORDER BY frame_idx)")
def gap_to_next(spark, sf_dir):
    return tl.gap_to_next(events(spark, sf_dir).withColumnRenamed("frame_idx", "seg_idx")).select("meeting_id", F.col("seg_idx").alias("frame_idx"), "gap_ms")


THRESHOLD = f"{EVENTS}, st AS (SELECT meeting_id, quantile_cont(value, 0.1) AS floor, quantile_cont(value, 0.9) AS peak FROM ev GROUP BY ALL), th AS (SELECT meeting_id, floor, peak, floor + least(18.0, greatest(5.0, 0.4 * (peak - floor))) AS threshold FROM st)"


@query(f"WITH {THRESHOLD} SELECT meeting_id, round(floor, 6) AS floor, round(peak, 6) AS peak, round(threshold, 6) AS threshold FROM th")
def noise_percentile_threshold(spark, sf_dir):
    t = tl.percentile_threshold(events(spark, sf_dir), "meeting_id", "value")
    return t.select("meeting_id", *[F.round(c, 6).alias(c) for c in ("floor", "peak", "threshold")])


@query(f"""WITH {THRESHOLD}, f AS (SELECT ev.*, value > threshold AS cand FROM ev JOIN th USING (meeting_id)),
    t AS (SELECT *, CASE WHEN count(*) OVER a = 2 AND min(CAST(cand AS INTEGER)) OVER a = 1 THEN true WHEN count(*) OVER b = 3 AND max(CAST(cand AS INTEGER)) OVER b = 0 THEN false END AS turn FROM f
        WINDOW a AS (PARTITION BY meeting_id ORDER BY frame_idx ROWS 1 PRECEDING), b AS (PARTITION BY meeting_id ORDER BY frame_idx ROWS 2 PRECEDING)),
    v AS (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), false) AS voiced FROM t),
    c AS (SELECT *, CASE WHEN lag(voiced) OVER (PARTITION BY meeting_id ORDER BY frame_idx) = voiced THEN 0 ELSE 1 END AS c FROM v),
    g AS (SELECT *, sum(c) OVER (PARTITION BY meeting_id ORDER BY frame_idx) AS g FROM c),
    s AS (SELECT meeting_id, min(frame_idx) * 10 AS start_ms, max(frame_idx) * 10 + 25 AS end_ms, avg(value) AS energy_db FROM g WHERE voiced GROUP BY meeting_id, g)
    SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms) - 1 AS INTEGER) AS seg_idx, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, round(energy_db, 6) AS energy_db FROM s""")
def hysteresis_segments(spark, sf_dir):
    ev = events(spark, sf_dir)
    rows = ev.join(tl.percentile_threshold(ev, "meeting_id", "value"), "meeting_id").withColumn("cand", F.col("value") > F.col("threshold"))
    rows = tl.hysteresis(rows, "meeting_id", "frame_idx", "cand", 2, 3).withColumn("rms_db", F.col("value"))
    return tl.frame_segments(rows).select("meeting_id", "seg_idx", "start_ms", "end_ms", rounded(F.col("energy_db"), 6).alias("energy_db"))


@query(f"""WITH {EVENTS}, i AS (SELECT meeting_id, frame_idx, value, frame_idx + 1 AS i FROM ev) SELECT meeting_id, frame_idx,
    round(0.15 * i + least(-60.0, min(value - 0.15 * i) OVER o), 6) AS floor, round(-0.05 * i + greatest(-60.0, max(value + 0.05 * i) OVER o), 6) AS peak FROM i WINDOW o AS (PARTITION BY meeting_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)""")
def noise_floor_online(spark, sf_dir):
    rows = tl.online_floor(events(spark, sf_dir), "meeting_id", "frame_idx", "value")
    return rows.select("meeting_id", "frame_idx", F.round("floor", 6).alias("floor"), F.round("peak", 6).alias("peak"))


HOUR = 3600 * 1000


@query(f"""WITH {EVENTS}, m AS (SELECT *, max(end_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev),
    g AS (SELECT *, sum(CASE WHEN reach IS NOT NULL AND start_ms - reach < {6 * HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM m),
    s AS (SELECT meeting_id, g, min(start_ms) AS start_ms, max(end_ms) AS end_ms, sum(value * (end_ms - start_ms)) / sum(end_ms - start_ms) AS energy_db FROM g GROUP BY ALL)
    SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms) - 1 AS INTEGER) AS seg_idx, start_ms, end_ms, round(energy_db, 6) AS energy_db FROM s""")
def gap_groups(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("energy_db", F.col("value"))
    return tl.merge_gaps(rows, 6 * HOUR).select("meeting_id", "seg_idx", "start_ms", "end_ms", F.round("energy_db", 6).alias("energy_db"))


@query(f"""WITH RECURSIVE {EVENTS}, r AS (SELECT meeting_id, frame_idx, start_ms AS s, end_ms AS e, 0 AS unit_idx FROM ev WHERE frame_idx = 0
    UNION ALL SELECT v.meeting_id, v.frame_idx, CASE WHEN v.start_ms - r.e <= {8 * HOUR} AND v.end_ms - r.s <= {48 * HOUR} THEN r.s ELSE v.start_ms END, CASE WHEN v.start_ms - r.e <= {8 * HOUR} AND v.end_ms - r.s <= {48 * HOUR} THEN greatest(r.e, v.end_ms) ELSE v.end_ms END,
        CASE WHEN v.start_ms - r.e <= {8 * HOUR} AND v.end_ms - r.s <= {48 * HOUR} THEN r.unit_idx ELSE r.unit_idx + 1 END FROM r JOIN ev v ON v.meeting_id = r.meeting_id AND v.frame_idx = r.frame_idx + 1)
    SELECT meeting_id, unit_idx, min(s) AS start_ms, max(e) AS end_ms, CAST(count(*) AS INTEGER) AS members FROM r GROUP BY meeting_id, unit_idx""")
def unit_groups_capped(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("seg_idx", F.col("frame_idx"))
    return tl.units(rows, 48 * HOUR, 8 * HOUR).select("meeting_id", "unit_idx", "start_ms", "end_ms", F.size("members").alias("members"))


@query("""WITH c AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM c)
    SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 6 HOUR AS end_ts, count(*) AS n FROM g GROUP BY user_id, g""")
def session_window_gap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start_ts"), F.col("s.end").cast("timestamp_ntz").alias("end_ts"), "n")


LABELS = f"{EVENTS}, lab AS (SELECT meeting_id, frame_idx, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS label FROM ev)"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", 2).otherwise(3)
    return events(spark, sf_dir).select("meeting_id", "frame_idx", kind.alias("label"))


@query(f"WITH {LABELS}, n AS (SELECT meeting_id, frame_idx, CASE WHEN label < 3 THEN label END AS label FROM lab) SELECT meeting_id, frame_idx, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 0) AS label FROM n")
def label_ffill(spark, sf_dir):
    return tl.forward_fill(labels(spark, sf_dir).withColumn("label", F.when(F.col("label") < 3, F.col("label"))), "meeting_id", "frame_idx", "label", 0)


@query(f"WITH {LABELS} SELECT meeting_id, frame_idx, CASE WHEN lag(label) OVER o = lead(label) OVER o THEN lag(label) OVER o ELSE label END AS label FROM lab WINDOW o AS (PARTITION BY meeting_id ORDER BY frame_idx)")
def isolated_label_smooth(spark, sf_dir):
    return tl.smooth_isolated(labels(spark, sf_dir), "meeting_id", "frame_idx", "label")


@query(f"WITH {LABELS}, n AS (SELECT a.meeting_id, a.frame_idx, b.label, count(*) AS n FROM lab a JOIN lab b ON a.meeting_id = b.meeting_id AND b.frame_idx BETWEEN a.frame_idx - 2 AND a.frame_idx + 2 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, frame_idx ORDER BY n DESC, label) AS r FROM n) SELECT meeting_id, frame_idx, label FROM r WHERE r = 1")
def label_mode_smooth(spark, sf_dir):
    return tl.smooth_mode(labels(spark, sf_dir), "meeting_id", "frame_idx", "label", 5)


@query(f"WITH {LABELS}, f AS (SELECT meeting_id, label, min(frame_idx) AS f FROM lab GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY meeting_id ORDER BY f) - 1 AS r FROM f) SELECT meeting_id, frame_idx, CAST(r AS INTEGER) AS label FROM lab JOIN r USING (meeting_id, label)")
def relabel_first_seen(spark, sf_dir):
    return tl.renumber(labels(spark, sf_dir), "meeting_id", "frame_idx", "label")


@query(f"""WITH {EVENTS}, d AS (SELECT meeting_id, frame_idx AS i, value AS d, count(*) OVER (PARTITION BY meeting_id) AS n, lag(value) OVER (PARTITION BY meeting_id ORDER BY frame_idx) AS p FROM ev),
    r AS (SELECT *, d / greatest(p, 1e-6) AS r FROM d WHERE i >= greatest(1, n - 8)), b AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY r DESC, i) AS k FROM r)
    SELECT m.meeting_id, CAST(coalesce(CASE WHEN b.r < 1.5 THEN 1 ELSE greatest(1, least(8, b.n - b.i)) END, 1) AS INTEGER) AS speakers FROM (SELECT DISTINCT meeting_id FROM ev) m LEFT JOIN b ON b.meeting_id = m.meeting_id AND b.k = 1""")
def merge_distance_jump(spark, sf_dir):
    return tl.speaker_count(events(spark, sf_dir).select("meeting_id", F.col("frame_idx").alias("step"), F.col("value").alias("distance")))


# ---- vectors and samples

NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))"


UNIT = f"u AS (SELECT vec_id, label, unnest(embedding) / {NORM} AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)"


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("features"))


@query(f"WITH {UNIT} SELECT vec_id, CAST(k AS INTEGER) AS k, round(x, 5) AS x FROM u")
def embedding_unit(spark, sf_dir):
    rows = voices(spark, sf_dir).select("vec_id", F.posexplode(vectors.unit(F.col("features"))).alias("k", "x"))
    return rows.select("vec_id", "k", F.round("x", 5).alias("x"))


@query(f"WITH {UNIT}, m AS (SELECT label, k, sum(x * (vec_id % 3 + 1)) / sum(vec_id % 3 + 1) AS x FROM u GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) SELECT label, CAST(k AS INTEGER) AS k, round(x / n, 5) AS mean FROM m JOIN n USING (label)")
def centroid_by_label(spark, sf_dir):
    rows = speech.weighted_centroids(voices(spark, sf_dir).withColumn("weight", F.col("vec_id") % 3 + 1), "label", "weight")
    return rows.select("label", F.posexplode("features").alias("k", "x")).select("label", "k", F.round("x", 5).alias("mean"))


@query(f"""WITH n AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    d AS (SELECT a.vec_id AS query_id, b.vec_id, round(1 - list_cosine_similarity(a.e, b.e), 6) AS d FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM d) SELECT query_id, vec_id, d AS distance FROM r WHERE r = 1""")
def nearest_neighbour(spark, sf_dir):
    """The nearest of all other voices for each query voice."""
    v = voices(spark, sf_dir)
    return speech.nearest(v, v.where("vec_id % 20 = 0"))


@query(f"""WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, lead(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) OVER (ORDER BY vec_id) AS f FROM embeddings)
    SELECT vec_id, round(1 - list_cosine_similarity(e, f), 6) AS distance FROM p WHERE f IS NOT NULL AND vec_id % 2 = 0""")
def pair_distance(spark, sf_dir):
    """Cosine distance of each even voice to the next id's."""
    v = voices(spark, sf_dir)
    follow = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("features").alias("other"))
    return v.where("vec_id % 2 = 0").join(follow, "vec_id").select("vec_id", F.round(vectors.cosine_distance(F.col("features"), F.col("other")), 6).alias("distance"))


DB = "CASE WHEN {0} > 1e-5 THEN 20 * log10({0}) ELSE -100.0 END"


@query(f"""WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
    b AS (SELECT vec_id, count(*) AS n, sqrt(avg(x * x)) AS rms FROM e GROUP BY vec_id, k // 20), q AS (SELECT vec_id, 20 * count(*) FILTER (WHERE n = 20 AND rms < 0.001) AS quiet FROM b GROUP BY vec_id),
    a AS (SELECT vec_id, count(*) AS duration_ms, max(abs(x)) AS p, sqrt(avg(x * x)) AS r, avg(CASE WHEN abs(x) >= 0.999 THEN 1.0 ELSE 0 END) AS clipping, avg(x) AS o FROM e GROUP BY vec_id)
    SELECT vec_id, duration_ms, round({DB.format("p")}, 6) AS peak_db, round({DB.format("r")}, 6) AS rms_db, round(clipping, 6) AS clipping, round(o, 6) AS "offset", CAST(quiet AS BIGINT) AS near_silent_ms FROM a JOIN q USING (vec_id)""")
def signal_quality(spark, sf_dir):
    """Levels of each vector as 1 kHz sound."""
    found = speech.quality(sound(spark, sf_dir))
    return found.select(F.col("meeting_id").alias("vec_id"), "duration_ms", *[F.round(c, 6).alias(c) for c in ("peak_db", "rms_db", "clipping", "offset")], "near_silent_ms")


def sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("meeting_id"), F.lit(1000).alias("sample_rate"), F.col("embedding").alias("samples"))


@query("""WITH s AS (SELECT vec_id, embedding, greatest(0, vec_id % 40 - 5) AS a, least(len(embedding), vec_id % 40 + 10 + vec_id % 20 + 5) AS z FROM embeddings)
    SELECT vec_id, CAST(a AS BIGINT) AS from_ms, CAST(greatest(0, z - a) AS INTEGER) AS n, round(coalesce(list_sum(list_transform(embedding[a + 1:z], lambda x: CAST(x AS DOUBLE))), 0), 5) AS total FROM s""")
def padded_slices(spark, sf_dir):
    """A padded piece of each vector as 1 kHz sound."""
    audio, m = sound(spark, sf_dir), F.col("meeting_id")
    cut = speech.slices(audio.select("meeting_id", (m % 40).alias("start_ms"), (m % 40 + 10 + m % 20).alias("end_ms")), audio, 5)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return cut.select(m.alias("vec_id"), "from_ms", F.size("samples").alias("n"), F.round(total, 5).alias("total"))


@query("WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) SELECT vec_id, CAST(k // 8 AS BIGINT) AS bucket, round(least(min(CAST(x AS DOUBLE)), 0), 6) AS low, round(greatest(max(CAST(x AS DOUBLE)), 0), 6) AS high FROM e GROUP BY ALL")
def waveform_envelope(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    return tl.envelope(rows, "vec_id", "k", "x", 8).select("vec_id", "bucket", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query()
def agglomerative(spark, sf_dir):
    """Clusters of the voices of every 50 consecutive ids: a meeting each."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).cast("long").alias("meeting_id"), (F.col("vec_id") % 50).cast("int").alias("seg_idx"), F.col("embedding").alias("features"))
    return speech.cluster(v)


@query(f"""WITH {EVENTS}, s AS (SELECT meeting_id, frame_idx AS i, CAST(CAST((value - 50) / 500 AS FLOAT) AS DOUBLE) AS x FROM ev),
    c AS (SELECT *, CASE WHEN (x < 0) <> (lead(x) OVER (PARTITION BY meeting_id ORDER BY i) < 0) THEN 1 ELSE 0 END AS c FROM s),
    w AS (SELECT meeting_id, i, count(*) OVER f AS n, sqrt(avg(x * x) OVER f) AS rms, sum(c) OVER (PARTITION BY meeting_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) / 25.0 AS zcr FROM c
        WINDOW f AS (PARTITION BY meeting_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING))
    SELECT meeting_id, CAST(i // 10 AS INTEGER) AS frame_idx, round(CASE WHEN rms > 1e-5 THEN greatest(20 * log10(rms), -100.0) ELSE -100.0 END, 6) AS rms_db, round(CAST(zcr AS DOUBLE), 6) AS zcr FROM w WHERE n = 25 AND i % 10 = 0
    UNION ALL SELECT meeting_id, 0, -100.0, 0.0 FROM s GROUP BY meeting_id HAVING count(*) < 25""")
def frame_levels(spark, sf_dir):
    """Levels of a user's values, less 50, as samples of 1 kHz sound."""
    x = F.struct("frame_idx", ((F.col("value") - 50) / 500).cast("float").alias("x"))
    audio = events(spark, sf_dir).groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(x)), lambda s: s["x"]).alias("samples")).withColumn("sample_rate", F.lit(1000))
    return speech.frame_levels(audio).select("meeting_id", "frame_idx", F.round("rms_db", 6).alias("rms_db"), F.round("zcr", 6).alias("zcr"))


# ---- whole minutes


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).groupBy("meeting_id").agg(F.max("end_ms").alias("duration_ms"))
    return rows.select("meeting_id", F.lit("").alias("title"), F.lit("2026-09-14").cast("date").alias("meeting_date"), F.array(F.lit("user"), F.lit("assistant"), F.lit("system")).alias("speaker_labels"), "duration_ms")


@query()
def minutes_reviewed(spark, sf_dir):
    made = pipeline.from_reviewed(meetings(spark, sf_dir), segments(spark, sf_dir).drop("label"), stopwords=stop_words(spark))
    return sinks.markdown(made, F.lit("2026-09-14 18:00:00"))
