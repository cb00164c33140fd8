"""Registered queries over Chinese turns: every turn of `conversations` says one of the fixed sentences.

The driver tables hold no CJK text, so each turn's sentence is chosen by its meeting and place; meetings are
held on different days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import chinese, text as tx
from ..functions import words as w
from ..operators import extract, timeline as tl
from ..sources import sinks, tables
from . import pipeline
from .queries import EVENTS, SAID, SEGMENTS, SPACES, events, query, segments, table

DAY = "CAST(DATE '2026-09-01' + CAST(meeting_id % 28 AS INTEGER) AS DATE)"
#: Turns with a sentence each, their confidence, and the sentence followed by the turn's own text.
SPOKEN = f"""{SEGMENTS}, spoken AS (SELECT meeting_id, seg_idx, seg_idx AS sent_idx, start_ms, end_ms, speaker_id, label, {DAY} AS day, (seg_idx % 10) / 10.0 AS confidence,
    [{", ".join(f"'{s}'" for s in SAID)}][CAST((meeting_id * 7 + seg_idx * 3) % {len(SAID)} AS INTEGER) + 1] AS text, text AS own FROM seg)"""
LABELS = ("user", "assistant", "system")


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).withColumn("sent_idx", F.col("seg_idx")).withColumn("own", F.col("text"))
    said = F.element_at(F.array(*map(F.lit, SAID)), ((F.col("meeting_id") * 7 + F.col("seg_idx") * 3) % len(SAID) + 1).cast("int"))
    return rows.withColumn("text", said).withColumn("confidence", (F.col("seg_idx") % 10) / 10)


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2026-09-01").cast("date"), (F.col("meeting_id") % 28).cast("int"))
    return segments(spark, sf_dir).select("meeting_id").distinct().select("meeting_id", day.alias("meeting_date"), F.array(*map(F.lit, LABELS)).alias("speaker_labels"))


def _kind() -> str:
    cases = []
    for name, triggers in w.DECISIONS:
        then = f"CASE WHEN regexp_matches(text, '{'|'.join(w.DENIALS)}') THEN '否决' ELSE '同意' END" if name == "同意" else f"'{name}'"
        cases.append(f"WHEN regexp_matches(text, '{'|'.join(triggers)}') THEN {then}")
    return "CASE " + " ".join(cases) + " END"


DECIDED = f"NOT regexp_matches(text, '[？?]$') AND NOT regexp_matches(text, '{'|'.join(w.ENQUIRIES)}') AND {_kind()} IS NOT NULL"
TRIGGER = "CASE WHEN regexp_matches(text, '[？?]$') THEN NULL " + " ".join(f"WHEN contains(text, '{t}') THEN '{t}'" for t in w.ACTION_TRIGGERS) + " END"
PRIORITY = f"CASE WHEN regexp_matches(text, '{'|'.join(w.HIGH)}') THEN '高' WHEN regexp_matches(text, '{'|'.join(w.LOW)}') THEN '低' ELSE '中' END"
ASKS = f"(regexp_matches(text, '({'|'.join(w.QUESTION_ENDS)})$') OR regexp_matches(text, '{'|'.join(w.QUESTION_INNER)}'))"
ORDERS = f"regexp_matches(text, '^({'|'.join(w.IMPERATIVE_STARTS)})')"
OWNER = "regexp_extract(text, '^(?:这个由|请|让|@)(李四|张三|王五|赵六)', 1)"
#: What each way to name a day means, from the meeting's day on.
DUE = """CASE WHEN contains(text, '九月二十日') THEN CASE WHEN day > DATE '2026-09-20' THEN DATE '2026-09-20' + 365 ELSE DATE '2026-09-20' END
    WHEN contains(text, '10月8日') THEN DATE '2026-10-08' WHEN contains(text, '今天') THEN day WHEN contains(text, '明天') THEN day + 1
    WHEN contains(text, '下周三') THEN day + CAST(10 - isodow(day) AS INTEGER)
    WHEN contains(text, '周五') THEN day + CAST(CASE WHEN isodow(day) < 5 THEN 5 - isodow(day) ELSE 12 - isodow(day) END AS INTEGER)
    WHEN contains(text, '3个工作日') THEN day + CASE isodow(day) WHEN 6 THEN 4 WHEN 7 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 5 END
    WHEN contains(text, '月底') THEN last_day(day) END"""
DUE_DATE = f"coalesce(strftime({DUE}, '%Y-%m-%d'), '')"
TASK = "regexp_replace(text, '^(嗯|那个|我们)+', '')"


@query(f"WITH {SPOKEN} SELECT meeting_id, seg_idx, {_kind()} AS kind, {DECIDED} AS decided FROM spoken")
def decision_classify(spark, sf_dir):
    text = F.col("text")
    return spoken(spark, sf_dir).select("meeting_id", "seg_idx", tx.decision_kind(text).alias("kind"), tx.is_decision(text).alias("decided"))


@query(f"""WITH {SPOKEN}, d AS (SELECT *, {_kind()} AS kind, row_number() OVER (PARTITION BY meeting_id, text ORDER BY sent_idx) AS r FROM spoken WHERE {DECIDED}),
    n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY sent_idx) AS n FROM d WHERE r = 1) SELECT meeting_id, sent_idx, text, kind, start_ms, speaker_id FROM n WHERE n <= {DEFAULT.max_decisions}""")
def decisions(spark, sf_dir):
    return extract.decisions(spoken(spark, sf_dir))


@query(f"WITH {SPOKEN} SELECT meeting_id, seg_idx, {PRIORITY} AS priority FROM spoken")
def priority(spark, sf_dir):
    return spoken(spark, sf_dir).select("meeting_id", "seg_idx", tx.priority(F.col("text")).alias("priority"))


@query(f"WITH {SPOKEN} SELECT meeting_id, seg_idx, {TRIGGER} AS trigger FROM spoken")
def action_trigger(spark, sf_dir):
    return spoken(spark, sf_dir).select("meeting_id", "seg_idx", tx.action_trigger(F.col("text")).alias("trigger"))


@query(f"WITH {SPOKEN} SELECT meeting_id, seg_idx, {ASKS} AS asks, {ORDERS} AS orders FROM spoken")
def sentence_mood(spark, sf_dir):
    return spoken(spark, sf_dir).select("meeting_id", "seg_idx", tx.interrogative(F.col("text")).alias("asks"), tx.imperative(F.col("text")).alias("orders"))


@query(f"WITH {SPOKEN} SELECT meeting_id, seg_idx, replace(replace(replace(replace(replace(text, '百分之三十', '30%'), '二零二六年', '2026年'), '三点五', '3.5'), '九月二十日', '9月20日'), '？', '?') AS text FROM spoken")
def itn(spark, sf_dir):
    return spoken(spark, sf_dir).select("meeting_id", "seg_idx", chinese.normalize_udf("text").alias("text"))


@query(f"""WITH {SPOKEN}, g AS (SELECT *, (seg_idx % 4) * 300 AS gap FROM spoken)
    SELECT meeting_id, seg_idx, text || CASE WHEN regexp_matches(text, '[{w.TERMINAL}]$') THEN '' WHEN {ASKS} THEN '？' WHEN {ORDERS} OR gap >= 800 THEN '。' WHEN gap >= 350 THEN '，' ELSE '' END AS text FROM g""")
def punct_restore(spark, sf_dir):
    rows = spoken(spark, sf_dir).withColumn("gap", F.col("seg_idx") % 4 * 300)
    return rows.select("meeting_id", "seg_idx", chinese.punctuate_udf("text", "gap").alias("text"))


@query(f"WITH {SPOKEN} SELECT meeting_id, seg_idx, {OWNER} AS owner FROM spoken")
def owner(spark, sf_dir):
    return spoken(spark, sf_dir).select("meeting_id", "seg_idx", chinese.owner_udf("text").alias("owner"))


@query(f"WITH {SPOKEN} SELECT meeting_id, seg_idx, {DUE_DATE} AS due_date FROM spoken")
def due_date(spark, sf_dir):
    rows = spoken(spark, sf_dir).join(held(spark, sf_dir), "meeting_id")
    return rows.select("meeting_id", "seg_idx", chinese.due_date_udf("text", "meeting_date").alias("d")).select("meeting_id", "seg_idx", "d.due_date")


@query(f"WITH {SPOKEN} SELECT meeting_id, seg_idx, {TASK} AS task FROM spoken")
def task_text(spark, sf_dir):
    return spoken(spark, sf_dir).select("meeting_id", "seg_idx", chinese.strip_fillers_udf("text").alias("task"))


@query(f"""WITH {SPOKEN}, a AS (SELECT *, {TASK} AS task, {TRIGGER} AS trigger FROM spoken), f AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, task ORDER BY sent_idx) AS r FROM a WHERE trigger IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY sent_idx) AS n FROM f WHERE r = 1)
    SELECT meeting_id, sent_idx, task, CASE WHEN {OWNER} <> '' THEN {OWNER} WHEN contains(text, '我') THEN {list(LABELS)}[speaker_id + 1] ELSE '' END AS owner, {DUE_DATE} AS due_date, {PRIORITY} AS priority FROM n WHERE n <= {DEFAULT.max_actions}""")
def action_items(spark, sf_dir):
    return extract.action_items(spoken(spark, sf_dir), held(spark, sf_dir)).select("meeting_id", "sent_idx", "task", "owner", "due_date", "priority")


MIXED = f"{SPOKEN}, mixed AS (SELECT * REPLACE (text || ' ' || own AS text) FROM spoken)"
CJK_CHARS = f"len(regexp_extract_all(text, '[{w.CJK}]'))"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken(spark, sf_dir).withColumn("text", F.concat_ws(" ", "text", "own"))


@query(f"""WITH {MIXED} SELECT meeting_id, count(*) AS n_segments, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum({CJK_CHARS}) AS BIGINT) AS n_cjk, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, max(end_ms) AS duration_ms,
    count(*) FILTER (WHERE confidence < {DEFAULT.low_confidence}) AS low_confidence, count(DISTINCT speaker_id) AS n_speakers FROM mixed GROUP BY meeting_id""")
def meeting_stats(spark, sf_dir):
    return extract.meeting_stats(mixed(spark, sf_dir))


@query(f"WITH {MIXED} SELECT meeting_id, speaker_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms, CAST(sum({CJK_CHARS}) AS BIGINT) AS chars FROM mixed GROUP BY ALL")
def speaker_stats(spark, sf_dir):
    return extract.speaker_stats(mixed(spark, sf_dir))


@query(f"""WITH {MIXED}, s AS (SELECT meeting_id, speaker_id, sum(end_ms - start_ms) AS t, sum({CJK_CHARS}) AS c FROM mixed GROUP BY ALL), m AS (SELECT DISTINCT meeting_id FROM mixed),
    l AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(LABELS))}) AS l(speaker_id, label))
    SELECT m.meeting_id, l.speaker_id, l.label, CAST(coalesce(t, 0) AS BIGINT) AS talk_ms, CAST(coalesce(c, 0) AS BIGINT) AS chars FROM m CROSS JOIN l LEFT JOIN s ON s.meeting_id = m.meeting_id AND s.speaker_id = l.speaker_id""")
def speaker_table(spark, sf_dir):
    """Every labelled speaker, the silent ones too."""
    return extract.speaker_stats(mixed(spark, sf_dir), held(spark, sf_dir)).select("meeting_id", "speaker_id", "label", "talk_ms", "chars")


@query(f"""WITH {MIXED} SELECT meeting_id, seg_idx, printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) AS time, label AS speaker, text, CAST(confidence AS DOUBLE) AS confidence,
    confidence < {DEFAULT.low_confidence} AS is_low_confidence FROM mixed""")
def transcript_view(spark, sf_dir):
    return sinks.transcript_view(mixed(spark, sf_dir), DEFAULT.low_confidence)


@query(f"WITH {SPOKEN} SELECT meeting_id, string_agg(text, '' ORDER BY seg_idx) AS full_text FROM spoken GROUP BY meeting_id")
def full_text(spark, sf_dir):
    return extract.full_text(spoken(spark, sf_dir))


@query(f"WITH {SPOKEN} SELECT meeting_id, seg_idx, CASE WHEN speaker_id = 0 THEN '未识别' WHEN speaker_id = 1 THEN 'user' ELSE '说话人2' END AS label FROM spoken")
def speaker_labels(spark, sf_dir):
    """Labels where the first speaker is unknown and the list names one only."""
    return spoken(spark, sf_dir).select("meeting_id", "seg_idx", tx.speaker_label(F.col("speaker_id") - 1, F.array(F.lit("user"))).alias("label"))


@query(f"WITH {SEGMENTS}, n AS (SELECT meeting_id, count(*) AS n FROM seg GROUP BY ALL) SELECT meeting_id, CASE WHEN n % 5 <= 1 THEN ['发言人'] ELSE list_transform(range(1, n % 5 + 1), lambda i: '说话人' || i) END AS labels FROM n")
def label_lists(spark, sf_dir):
    rows = segments(spark, sf_dir).groupBy("meeting_id").agg(F.count("*").alias("n"))
    return rows.select("meeting_id", tx.speaker_labels(F.col("n") % 5).alias("labels"))


@query(f"WITH {SEGMENTS}, n AS (SELECT meeting_id, count(*) AS n FROM seg GROUP BY ALL) SELECT meeting_id, CAST(least(n, greatest({3}, least({12}, ceil(n * 0.5)))) AS INTEGER) AS target FROM n")
def target_counts(spark, sf_dir):
    rows = segments(spark, sf_dir).groupBy("meeting_id").agg(F.count("*").alias("n"))
    return rows.select("meeting_id", tx.target_sentences(F.col("n"), 0.5, 3, 12).alias("target"))


@query(f"WITH {SPOKEN} SELECT meeting_id, seg_idx, translate(text, '决议调进', '決議調進') AS text, len(regexp_extract_all(text, '[决议调进]')) > 0 AS changed FROM spoken")
def character_map(spark, sf_dir):
    text = tx.convert_characters(F.col("text"), {"决": "決", "议": "議", "调": "調", "进": "進"})
    return spoken(spark, sf_dir).select("meeting_id", "seg_idx", text.alias("text"), (text != F.col("text")).alias("changed"))


@query(f"""WITH {SPOKEN}, m AS (SELECT meeting_id, seg_idx, CASE seg_idx % 4 WHEN 0 THEN '[BLANK_AUDIO]' WHEN 1 THEN '(silence)' WHEN 2 THEN text ELSE '' END AS text FROM spoken)
    SELECT meeting_id, seg_idx, seg_idx % 4 < 2 AS blank FROM m""")
def blank_speech(spark, sf_dir):
    k = F.col("seg_idx") % 4
    text = F.when(k == 0, "[BLANK_AUDIO]").when(k == 1, "(silence)").when(k == 2, F.col("text")).otherwise("")
    return spoken(spark, sf_dir).select("meeting_id", "seg_idx", tx.blank_speech(text).alias("blank"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(f"""WITH {SEGMENTS} SELECT meeting_id, seg_idx, translate(text, '{UPPER}', '{LOWER}') AS low, translate(text, '{LOWER}', '{UPPER}') AS up, lpad(CAST(seg_idx AS VARCHAR), CAST(greatest(3, len(CAST(seg_idx AS VARCHAR))) AS INTEGER), '0') AS padded,
    list_filter(regexp_split_to_array(text, '[ ,]'), lambda x: x <> '') AS parts, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {SPACES})), lambda x: x <> '') AS lines,
    starts_with(text, 'T') AS starts, ends_with(text, '.') AS ends, contains(text, 'the') AS has, replace(text, 'e', '__') AS replaced, repeat(left(text, 2), 3) AS repeated, substr(text, 3, 5) AS piece, length(text) AS n FROM seg""")
def string_functions(spark, sf_dir):
    s = F.col("text")
    return segments(spark, sf_dir).select("meeting_id", "seg_idx", tx.lower_ascii(s).alias("low"), tx.upper_ascii(s).alias("up"), tx.pad_left(F.col("seg_idx").cast("string"), 3, "0").alias("padded"), tx.split_any(s, " ,").alias("parts"), tx.split_lines(s).alias("lines"),
        s.startswith("T").alias("starts"), s.endswith(".").alias("ends"), s.contains("the").alias("has"), F.replace(s, F.lit("e"), F.lit("__")).alias("replaced"), F.repeat(F.substring(s, 1, 2), 3).alias("repeated"), F.substring(s, 3, 5).alias("piece"), F.length(s).cast("long").alias("n"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html, replace(replace(html, '|', '\\|'), chr(10), ' ') AS cell FROM pages""")
def escapes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.html_escape(F.col("html")).alias("html"), tx.markdown_cell(F.col("html")).alias("cell"))


@query(f"""WITH {SEGMENTS}, x AS (SELECT meeting_id, seg_idx, start_ms, (seg_idx - 3) * 1.5 AS v FROM seg)
    SELECT meeting_id, seg_idx, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE printf('%.1f', CAST(v AS DOUBLE)) END AS number, printf('%02d:%02d', start_ms // 60000, start_ms // 1000 % 60) AS short,
    printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS clock, CAST(start_ms * 441 // 10 AS BIGINT) AS samples FROM x""")
def number_formats(spark, sf_dir):
    start = F.col("start_ms")
    return segments(spark, sf_dir).select("meeting_id", "seg_idx", tx.number_string((F.col("seg_idx") - 3) * 1.5, 3).alias("number"), tx.short_time(start).alias("short"), tx.clock(start).alias("clock"), tx.ms_to_samples(start, F.lit(44100)).alias("samples"))


@query(f"""WITH {EVENTS}, d AS (SELECT meeting_id, max(end_ms) * 2 // 5 AS duration_ms FROM ev GROUP BY ALL), c AS (SELECT meeting_id, greatest(start_ms, 0) AS start_ms, least(end_ms, duration_ms) AS end_ms FROM ev JOIN d USING (meeting_id)),
    k AS (SELECT * FROM c WHERE end_ms - start_ms >= 50000), r AS (SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms) - 1 AS INTEGER) AS seg_idx, start_ms, end_ms FROM k)
    SELECT * FROM r UNION ALL SELECT meeting_id, 0, CAST(0 AS BIGINT), CAST(duration_ms AS BIGINT) FROM d WHERE duration_ms >= 50000 AND meeting_id NOT IN (SELECT meeting_id FROM k)""")
def clipped_segments(spark, sf_dir):
    """Segments within the first two fifths of a user's time that last 50 s; one over all of it where none does."""
    ev = events(spark, sf_dir)
    audio = ev.groupBy("meeting_id").agg(F.floor(F.max("end_ms") * 2 / 5).cast("long").alias("duration_ms"))
    rows = tl.clip(ev.select("meeting_id", F.col("frame_idx").alias("seg_idx"), "start_ms", "end_ms", F.col("value").alias("energy_db")), audio, 50000)
    return tl.whole_if_none(rows, audio, 50000).select("meeting_id", "seg_idx", "start_ms", "end_ms")


@query("""WITH base AS (SELECT event_type || event_id % 50 AS word, CAST(1 + event_id % 7 AS DOUBLE) AS freq, event_id FROM events), t AS (SELECT greatest(sum(freq), 1) AS total FROM base),
    u AS (SELECT word, arg_max(freq, event_id) AS freq FROM base GROUP BY word UNION ALL SELECT event_type || event_id % 60, CAST(1 + event_id % 11 AS DOUBLE) FROM events)
    SELECT word, round(max(ln(freq) - ln(total)), 6) AS log_prob FROM u, t GROUP BY word""")
def lexicon_union(spark, sf_dir):
    ev, i = table(spark, sf_dir, "events"), F.col("event_id")
    base = ev.select(F.concat("event_type", (i % 50).cast("string")).alias("word"), (1 + i % 7).cast("double").alias("freq"), i.alias("line_no"))
    extra = ev.select(F.concat("event_type", (i % 60).cast("string")).alias("word"), (1 + i % 11).cast("double").alias("freq"))
    return tables.lexicon(base, extra).select("word", F.round("log_prob", 6).alias("log_prob"))


@query(f"""WITH {SPOKEN} SELECT meeting_id, seg_idx AS unit_idx, CASE WHEN seg_idx >= {len(SAID)} THEN '' WHEN seg_idx % 3 = 2 THEN '' ELSE [{", ".join(f"'{s}'" for s in SAID)}][seg_idx + 1] END AS text,
    CAST(CASE WHEN seg_idx >= {len(SAID)} THEN 1.0 WHEN seg_idx % 3 = 2 THEN 0.0 ELSE 0.95 END AS DOUBLE) AS confidence FROM spoken""")
def replayed_script(spark, sf_dir):
    """Units that a script's lines are played to: every third line is silence."""
    lines = spark.createDataFrame([(i, "" if i % 3 == 2 else s) for i, s in enumerate(SAID)], "line_no int, text string")
    return pipeline.replay(segments(spark, sf_dir).select("meeting_id", F.col("seg_idx").alias("unit_idx")), lines)


@query(f"""WITH {SEGMENTS}, t AS (SELECT meeting_id, seg_idx, regexp_replace(text, '[^A-Za-z]', '', 'g') AS t FROM seg), n AS (SELECT *, length(t) AS n FROM t), a AS (SELECT *, least(greatest(CAST(floor(3.0::DOUBLE / 6 * n + 0.5) AS BIGINT), 1), n - 2) AS a FROM n),
    b AS (SELECT *, least(greatest(CAST(floor(4.0::DOUBLE / 6 * n + 0.5) AS BIGINT), a + 1), n - 1) AS b FROM a),
    p AS (SELECT meeting_id, seg_idx, CASE WHEN n < 3 THEN [substr(t, 1, 1), substr(t, 2, 1), ''] ELSE [substr(t, 1, a), substr(t, a + 1, b - a), substr(t, b + 1)] END AS p FROM b)
    SELECT meeting_id, seg_idx, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS k, unnest(p) AS part FROM p""")
def weighted_split(spark, sf_dir):
    """The letters of each turn in shares of 3, 1 and 2; letters alone have no better place to cut."""
    rows = segments(spark, sf_dir).select("meeting_id", "seg_idx", F.regexp_replace("text", "[^A-Za-z]", "").alias("text"))
    return rows.select("meeting_id", "seg_idx", F.posexplode(chinese.split_by_weights_udf(F.col("text"), F.array(F.lit(3), F.lit(1), F.lit(2)))).alias("k", "part"))
