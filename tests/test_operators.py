import json
import math
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.config import DEFAULT, Config
from parley.functions import signal, text as tx
from parley.operators import extract, rank, speech, timeline as tl
from parley.plans import pipeline
from parley.sources import sessions, sinks, tables, wav
from parley.streaming import live, replay


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("enter,leave", [(1, 1), (2, 3), (3, 8)])
def test_hysteresis_equals_a_state_machine(spark, enter, leave):
    rng = random.Random(enter * 10 + leave)
    flags = [[rng.random() < 0.5 for _ in range(60)] for _ in range(5)]
    df = spark.createDataFrame([(m, i, x) for m, xs in enumerate(flags) for i, x in enumerate(xs)], "m int, i int, x boolean")
    want = []
    for m, xs in enumerate(flags):
        on, run, quiet = False, 0, 0
        for i, x in enumerate(xs):
            run, quiet = (run + 1, 0) if x else (0, quiet + 1)
            on = on and quiet < leave or run >= enter
            want.append((m, i, on))
    assert rows(tl.hysteresis(df, "m", "i", "x", enter, leave), "m", "i", "voiced") == want


def segs(spark, spans):
    return spark.createDataFrame([("m", i, s, e, -20.0) for i, (s, e) in enumerate(spans)], "meeting_id string, seg_idx int, start_ms long, end_ms long, energy_db double")


def test_units(spark):
    s = segs(spark, [(2000 * i, 2000 * i + 1200) for i in range(5)])
    assert rows(tl.units(s, 25000, 1500), "start_ms", "end_ms") == [(0, 9200)]
    s = segs(spark, [(10000 * i, 10000 * i + 1000) for i in range(4)])
    got = tl.units(s, 25000, 1500).collect()
    assert len(got) == 4 and sorted(i for r in got for i in r.members) == [0, 1, 2, 3]
    assert len(tl.units(s, 0, 99999).collect()) == 4
    long = segs(spark, [(i * 1000, i * 1000 + 900) for i in range(50)])
    got = tl.units(long, 10000, 1500).collect()
    assert all(r.end_ms - r.start_ms <= 10000 for r in got) and len(got) == 5


def test_merge_and_labels(spark):
    s = segs(spark, [(0, 100), (399, 500), (800, 900)])
    assert rows(tl.merge_gaps(s, 300), "start_ms", "end_ms") == [(0, 500), (800, 900)]
    assert rows(tl.merge_gaps(s, 300, inclusive=True), "start_ms", "end_ms") == [(0, 900)]
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate([2, 1, 2, 2, 0, 0, 2])], "meeting_id string, seg_idx int, speaker_id int")
    smooth = tl.smooth_isolated(df, "meeting_id", "seg_idx", "speaker_id")
    assert [r[1] for r in rows(smooth, "seg_idx", "speaker_id")] == [2, 2, 2, 2, 0, 0, 2]
    assert [r[1] for r in rows(tl.renumber(smooth, "meeting_id", "seg_idx", "speaker_id"), "seg_idx", "speaker_id")] == [0, 0, 0, 0, 1, 1, 0]
    t = tl.turns(smooth.withColumn("start_ms", F.col("seg_idx") * 10).withColumn("end_ms", F.col("seg_idx") * 10 + 5))
    assert rows(t, "turn_idx", "speaker_id", "n_segments") == [(0, 2, 4), (1, 0, 2), (2, 2, 1)]


def test_speaker_count(spark):
    data = {"a": [0.1, 0.5, 0.55, 0.6], "b": [0.1, 0.11, 0.12], "c": [0.3]}
    df = spark.createDataFrame([(m, i, d) for m, ds in data.items() for i, d in enumerate(ds)], "meeting_id string, step int, distance double")
    want = {m: signal.jump_count(d) for m, d in data.items()}
    assert dict(rows(tl.speaker_count(df), "meeting_id", "speakers")) == want
    assert signal.jump_count([]) == 1 and want["b"] == 1


def test_review(spark):
    t = spark.createDataFrame([("m", i, i * 10, i * 10 + 9, 0, f"t{i}") for i in range(5)], "meeting_id string, seg_idx int, start_ms long, end_ms long, speaker_id int, text string")
    e = spark.createDataFrame([("m", 1, "merge", None), ("m", 2, "delete", None), ("m", 3, "speaker", "7"), ("m", 4, "text", "new")], "meeting_id string, seg_idx int, op string, value string")
    assert rows(tl.review(t, e), "seg_idx", "end_ms", "speaker_id", "text") == [(0, 19, 0, "t0t1"), (3, 39, 7, "t3"), (4, 49, 0, "new")]


def test_rank():
    assert rank.rank_graph([0, 1, 2], []) == {0: pytest.approx(0.15), 1: pytest.approx(0.15), 2: pytest.approx(0.15)}
    s = rank.rank_graph([0, 1, 2], [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 0.5), (1, 1, 9.0)])
    assert s[2] > s[0]
    assert rank.pick([1.0, 0.99, 0.5], {(0, 1): 1.0}, 2, 0.5) == [0, 2]


def test_topics_cover_all_sentences(spark):
    a, b = ["budget", "money", "cost"], ["design", "screen", "color"]
    sents = [a] * 9 + [b] * 9
    df = spark.createDataFrame([("m", i, " ".join(t), t) for i, t in enumerate(sents)] + [("n", 0, "x", ["budget"])], "meeting_id string, sent_idx int, text string, tokens array<string>")
    got = [r for r in rank.topics(df).orderBy("topic_idx").collect() if r.meeting_id == "m"]
    assert got[0].start_sentence == 0 and got[-1].end_sentence == 18
    assert all(x.end_sentence == y.start_sentence for x, y in zip(got, got[1:])) and len(got) == 2
    k = rank.keywords(df).where("meeting_id = 'm'").orderBy("rank").collect()
    assert all(x.score >= y.score - 1e-9 for x, y in zip(k, k[1:]))
    assert rank.summary(df).where("meeting_id = 'n'").count() == 1


def test_cosine_and_clusters():
    d = signal.cosine_distance
    assert [round(d(np.array(a), np.array(b)), 9) for a, b in (([1, 0], [1, 0]), ([1, 0], [0, 1]), ([1, 0], [-1, 0]), ([1, 0], [1]), ([0, 0], [1, 0]))] == [0, 1, 2, 1, 1]
    labels, _ = signal.agglomerate([np.array([1.0, 0])] * 5 + [np.array([0, 1.0])] * 3, threshold=0.3)
    assert labels == [0] * 5 + [1] * 3


def speech_like(ms, rate=16000, seed=1):
    t = np.arange(ms * rate // 1000) / rate
    x = sum(np.sin(2 * np.pi * 120 * k * t) / k for k in range(1, 20)) * (0.6 + 0.4 * np.sin(2 * np.pi * 4 * t))
    return 0.3 * x / np.abs(x).max() + np.random.default_rng(seed).normal(0, 1e-4, len(t))


def clip(parts, rate=16000):
    return np.concatenate([speech_like(ms, rate) if loud else np.random.default_rng(3).normal(0, 1e-4, ms * rate // 1000) for loud, ms in parts])


def audio_frame(spark, clips, rate=16000):
    return spark.createDataFrame([(m, rate, [float(v) for v in x]) for m, x in clips.items()], "meeting_id string, sample_rate int, samples array<float>")


def test_voice_activity(spark):
    x = clip([(0, 300)] + [(1, 1000), (0, 800)] * 4)
    df = audio_frame(spark, {"talk": x, "silence": np.zeros(32000)})
    got = speech.voice_activity(df).orderBy("meeting_id", "seg_idx").collect()
    talk = [r for r in got if r.meeting_id == "talk"]
    assert 3 <= len(talk) <= 5 and abs(talk[0].start_ms - 300) <= 60
    assert [(r.start_ms, r.end_ms) for r in got if r.meeting_id == "silence"] == [(0, 2000)]
    q = {r.meeting_id: r for r in speech.quality(df).collect()}
    assert q["silence"].near_silent_ms == 2000 and q["talk"].peak_db > -15
    assert speech.resample(audio_frame(spark, {"a": speech_like(100, 8000)}, 8000)).select(F.size("samples")).first()[0] == 1600


def test_live_chunks_change_nothing():
    x = clip([(0, 500)] + [(1, 1000), (0, 1000)] * 3)
    want = None
    for size in (len(x), 1600, 777):
        s = live.Segmenter(16000, Config(live_exit_frames=30))
        out = [r for i in range(0, len(x), size) for r in s.feed(x[i : i + size])] + s.close()
        want = want or out
        assert out == want
    assert len(want) == 3 and all(800 <= e - s <= 1400 for _, s, e, _ in want)


def test_stream_equals_whole(spark, tmp_path):
    x = clip([(0, 500)] + [(1, 1000), (0, 1000)] * 2)
    rowlist = [("m", k, 16000, [float(v) for v in x[i : i + 8000]], i + 8000 >= len(x)) for k, i in enumerate(range(0, len(x), 8000))]
    schema = "meeting_id string, chunk_seq long, sample_rate int, samples array<float>, last boolean"
    for k in (0, 1, 2):
        spark.createDataFrame(rowlist[k * 4 : (k + 1) * 4 if k < 2 else None], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.segment_stream(stream, Config(live_exit_frames=30)).writeStream.format("memory").queryName("live_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted(tuple(r)[1:4] for r in spark.table("live_out").collect())
    s = live.Segmenter(16000, Config(live_exit_frames=30))
    want = [r[:3] for r in s.feed(np.asarray(x, np.float32)) + s.close()]
    assert got == want and len(got) == 2


def test_replayed_captions(spark, tmp_path):
    x = clip([(0, 500)] + [(1, 1000), (0, 1000)] * 2, 8000)
    (tmp_path / "m.wav").write_bytes(wav.encode(x, 8000))
    x = wav.decode((tmp_path / "m.wav").read_bytes())
    reader = replay.ReplayReader([str(tmp_path / "m.wav")], 1e9, 100)
    parts = [r for a, b in ((0, 3), (3, 99)) for p in reader.partitions({"chunk": a}, {"chunk": b}) for r in reader.read(p)]
    assert np.array_equal(np.concatenate([r[3] for r in parts]).astype(np.float32), x) and [r[1] for r in parts] == list(range(len(parts)))
    assert [r[4] for r in parts] == [False] * (len(parts) - 1) + [True] and reader.initialOffset() == {"chunk": 0}
    with pytest.raises(ValueError):
        reader.partitions({"chunk": 5}, {"chunk": 1})
    spark.dataSource.register(replay.ReplaySource)
    chunks = spark.readStream.format("wav_replay").option("paths", str(tmp_path / "m.wav")).option("speed", "1e9").load()
    said = F.when(F.col("seg_idx") == 0, "[BLANK_AUDIO]").otherwise(F.concat(F.lit("過去百分之三十"), F.size("samples").cast("string")))
    found = live.captions(live.segment_stream(chunks, Config(live_exit_frames=30), sound=True), lambda s: s.withColumn("text", said), {"過": "过"})
    q = found.writeStream.format("memory").queryName("captions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(90):
            q.processAllAvailable()
            if spark.table("captions_out").count():
                break
    finally:
        q.stop()
    s = live.Segmenter(8000, Config(live_exit_frames=30), sound=True)
    want = []
    for i in range(0, len(x), 800):
        want += [(r, s.cut(r[1], r[2])) for r in s.feed(x[i : i + 800]) + (s.close() if i + 800 >= len(x) else [])]
    assert len(want) == 2
    (_, start, end, _), (at, samples) = want[1]
    assert at == start - 200 and np.array_equal(samples, x[at * 8 : at * 8 + len(samples)]) and len(samples) <= (end - start + 400) * 8
    got = spark.table("captions_out").collect()
    assert [(r.seg_idx, r.start_ms, r.slice_start_ms, list(r.samples)) for r in got] == [(1, start, at, samples.tolist())]
    assert got[0].text.startswith("过去30%") and got[0].text.endswith("。")


def test_live_keeps_bounded_sound():
    s = live.Segmenter(1000, Config(live_max_segment_ms=500, live_margin_ms=100), sound=True)
    for i in range(20):
        s.feed(np.full(100, float(i)))
        s.forget()
    assert len(s.heard) == 600 and s.dropped == 1400
    assert s.cut(0, 1500) == (1400, pytest.approx([14.0] * 100 + [15.0] * 100 + [16.0] * 100))
    assert len(live.Segmenter.restored(s.saved(), s.config).heard) == 600


def test_wav(spark, tmp_path):
    x = speech_like(50)
    for bits in (16, 32):
        raw = wav.encode(x, 16000, bits)
        assert np.allclose(wav.decode(raw), x, atol=1e-4) and wav.header(raw[:-7])["n_frames"] < len(x)
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 16000))
    (tmp_path / "bad.wav").write_bytes(b"RIFF" + b"\0" * 60)
    got = {r.meeting_id: r for r in wav.read(spark, str(tmp_path)).collect()}
    assert got["a"].n_frames == len(x) == len(got["a"].samples) and got["bad"].error
    spark.dataSource.register(wav.WavSource)
    head = spark.read.format("wav").option("paths", str(tmp_path / "a.wav")).option("headOnly", "true").load()
    assert "samples" not in head.columns and head.first().n_frames == len(x)
    (tmp_path / "long.wav").write_bytes(wav.encode(np.zeros(50000), 16000))
    assert spark.read.format("wav").option("paths", str(tmp_path / "long.wav")).option("headOnly", "true").load().first().n_frames == 50000
    for code, width, body in ((1, 8, bytes([128, 255])), (1, 24, b"\0\0\x40\0\0\xc0")):
        import struct

        raw = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, code, 1, 8000, 8000, width // 8, width) + b"data" + struct.pack("<I", len(body)) + body
        assert np.allclose(wav.decode(raw + b"\0" * 8), [0, 127 / 128] if width == 8 else [0.5, -0.5])


def test_audio_to_minutes(spark):
    x = clip([(0, 300), (1, 1500), (0, 3500), (1, 1500), (0, 500)])
    script = spark.createDataFrame([(0, "我们决定采用新的方案"), (1, "请张三跟进上线进度百分之三十")], "line_no int, text string")
    meetings = spark.sql("SELECT 'm' AS meeting_id, '' AS title, DATE'2026-09-14' AS meeting_date")
    made = pipeline.from_audio(audio_frame(spark, {"m": x}), meetings, lambda u: pipeline.replay(u, script)).collect()
    assert len(made) == 1
    m = made[0]
    assert [d.kind for d in m.decisions] == ["确定"] and [a.owner for a in m.action_items] == ["张三"] and "30%" in m.action_items[0].task
    assert m.overview and m.duration_ms == 7300 and m.title


def test_reviewed_import_and_sinks(spark, tmp_path):
    doc = {"title": "", "meetingDate": "2026-09-14", "quality": {"durationMs": 9000}, "speakerLabels": ["甲", "乙"], "asr": {"segments": [{"startMs": 0, "endMs": 3000, "text": "产品评审会今天开始。我们决定采用方案A。", "speakerId": 0}, {"startMs": 3500, "endMs": 6500, "text": "我来整理会议记录，下周三之前完成。", "speakerId": 1}, {"startMs": 7000, "endMs": 9000, "text": "  ", "speakerId": 1}]}}
    (tmp_path / "m1.json").write_text(json.dumps(doc, ensure_ascii=False))
    meetings, segments = tables.reviewed(spark, str(tmp_path / "m1.json"))
    made = pipeline.from_reviewed(meetings, segments)
    m = made.collect()[0]
    assert m.title == "产品评审会今天开始" and m.action_items[0].owner == "乙" and m.action_items[0].due_date == "2026-09-23"
    assert m.n_segments == 3 and {s.label: s.talk_ms for s in m.speakers} == {"甲": 3000, "乙": 5000}
    md = sinks.markdown(made).first().markdown
    assert "| 1 | 我来整理会议记录" in md and "**甲**\n\n`00:00:00` 产品评审会" in md and "## 九" not in md
    page = sinks.html(made).first().html
    assert "<script" not in page and "方案A" in page
    cues = sinks.srt_lines(segments.withColumn("label", F.lit("甲"))).orderBy("n").collect()
    assert len(cues) == 2 and cues[0].cue.startswith("1\n00:00:00,000 --> 00:00:03,000\n[甲] ")
    made_files = sinks.write_all(made, segments.withColumn("label", F.lit("甲")), str(tmp_path / "out"), ("markdown", "json", "srt"))
    assert spark.read.json(made_files["json"]).count() == 1
    made_files = sinks.write_all(made, segments.withColumn("label", F.lit("甲")), str(tmp_path / "files"), ("srt",), files=True)
    written = list((tmp_path / "files" / "srt").glob("name=*/*.txt"))
    assert len(written) == 1 and "产品评审会今天开始_2026-09-14" in str(written[0])
    assert written[0].read_text() == cues[0].cue + "\n" + cues[1].cue + "\n"


MINUTES = """SELECT 'm' AS meeting_id, '周会' AS title, DATE'2026-09-14' AS meeting_date, 9000L AS duration_ms, 4500L AS speech_ms, 0.5D AS speech_ratio, 12L AS n_cjk, 2L AS n_speakers,
    '概览<一>' AS overview, 'in|put/甲.wav' AS input_path, 'script' AS backend, array('a.md') AS files,
    array(named_struct('title', 'A / B', 'keywords', array('A', 'B'), 'start_ms', 1000L), named_struct('title', '议题 2', 'keywords', array(), 'start_ms', -1L)) AS topics,
    array(named_struct('text', '要点一。', 'start_ms', 0L), named_struct('text', '要点二。', 'start_ms', CAST(NULL AS BIGINT))) AS key_points,
    array(named_struct('kind', '确定', 'text', '用方案A。', 'start_ms', 2000L)) AS decisions,
    array(named_struct('task', '写|报告', 'owner', '', 'due_date', '', 'due_text', '', 'priority', '高'), named_struct('task', '发布', 'owner', '李|四', 'due_date', '2026-09-18', 'due_text', '周五', 'priority', '中'),
        named_struct('task', '测试', 'owner', '甲', 'due_date', '', 'due_text', '尽快', 'priority', '中')) AS action_items,
    array(named_struct('word', '方案', 'frequency', 3L), named_struct('word', '报告', 'frequency', 2L)) AS keywords, array('一条风险') AS risks,
    array(named_struct('start_ms', 0L, 'speaker_id', 0, 'label', '甲', 'text', '早。'), named_struct('start_ms', 1000L, 'speaker_id', 0, 'label', '甲', 'text', '开始。'), named_struct('start_ms', 2000L, 'speaker_id', 9, 'label', '乙&', 'text', '好。')) AS lines"""


def test_markdown_whole(spark):
    got = sinks.markdown(spark.sql(MINUTES), F.lit("2026-09-14 18:00:00")).first().markdown
    assert got == (
        "# 周会\n\n| 项目 | 内容 |\n| --- | --- |\n| 会议日期 | 2026-09-14 |\n| 音频时长 | 00:00:09 |\n| 有效语音 | 00:00:04（50%） |\n| 转写字数 | 12 字 |\n| 说话人数 | 2 |\n"
        "| 识别后端 | script |\n| 源文件 | `in\\|put/甲.wav` |\n| 生成时间 | 2026-09-14 18:00:00 |\n\n## 一、会议概览\n\n概览<一>\n\n"
        "## 二、议题脉络\n\n1. **A / B**（关键词：A、B） — 起始于 00:00:01\n2. **议题 2**\n\n## 三、关键结论\n\n- `00:00:00` 要点一。\n- 要点二。\n\n## 四、会议决议\n\n- [确定] 用方案A。（`00:00:02`）\n\n"
        "## 五、待办事项\n\n| # | 任务 | 责任人 | 截止时间 | 优先级 |\n| --- | --- | --- | --- | --- |\n| 1 | 写\\|报告 | 待指定 | 待定 | 高 |\n| 2 | 发布 | 李\\|四 | 2026-09-18 | 中 |\n| 3 | 测试 | 甲 | 尽快 | 中 |\n\n"
        "## 六、关键词\n\n方案(3)、报告(2)\n\n## 七、风险与待确认\n\n- 一条风险\n\n## 八、全文转写\n\n\n**甲**\n\n`00:00:00` 早。\n\n`00:00:01` 开始。\n\n\n**乙&**\n\n`00:00:02` 好。\n\n"
        "## 九、本次导出的文件\n\n- `a.md`\n\n"
    )


def test_text_html_and_names(spark, tmp_path):
    made = spark.sql(MINUTES)
    assert sinks.text(made).first().txt == "周会\n会议日期: 2026-09-14    时长: 00:00:09\n" + "=" * 60 + "\n\n[00:00:00] 甲: 早。\n[00:00:01] 甲: 开始。\n[00:00:02] 乙&: 好。\n"
    page = sinks.html(made).first().html
    assert page.startswith('<!DOCTYPE html>\n<html lang="zh-CN">') and "<p>概览&lt;一&gt;</p>" in page and "<td>待指定</td><td>待定</td><td>高</td>" in page and "<td>李|四</td><td>2026-09-18</td>" in page
    assert '<span class="who" style="color:#16a34a">乙&amp;</span>' in page and '<span class="who" style="color:#2563eb">甲</span>' in page and page.count("<h2>") == 8
    for options, name in (({}, "甲_2026-09-14"), ({"base_name": "my:notes"}, "my_notes")):
        at = sinks.write_all(made, made, str(tmp_path / name), ("txt",), files=True, **options)["txt"]
        assert [p.name for p in Path(at).glob("name=*")] == [f"name={name}"]
    empty = made.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in ("overview", "input_path", "backend", "files", "meeting_date") else F.array().cast(f.dataType).alias(f.name) if f.dataType.typeName() == "array" else f.name for f in made.schema])
    assert sinks.markdown(empty).first().markdown.endswith("## 八、全文转写\n\n") and sinks.html(empty).first().html.count("<h2>") == 1


def test_small_functions(spark):
    said = lambda ms: spark.range(1).select(tx.spoken_duration(F.lit(ms)).alias("x")).first().x
    assert [said(ms) for ms in (0, -5, 999, 61_000, 3_600_000, 3_661_000, 120_000)] == ["0 秒", "0 秒", "0 秒", "1 分钟 1 秒", "1 小时", "1 小时 1 分钟", "2 分钟"]
    row = spark.range(1).select(tx.needs_conversion(F.lit("會议"), {"會": "会"}).alias("a"), tx.needs_conversion(F.lit("会议"), {"會": "会"}).alias("b"), tx.needs_conversion(F.lit("會"), {}).alias("c"), tx.real_time_factor(F.lit(9000), F.lit(3000)).alias("d"), tx.real_time_factor(F.lit(9000), F.lit(0)).alias("e")).first()
    assert tuple(row) == (True, False, False, 3.0, 0.0)
    c = np.random.default_rng(1).normal(size=(50, 13))
    assert np.allclose(signal.mean_normalized(c).mean(axis=0), 0) and np.allclose(np.diff(signal.mean_normalized(c), axis=0), np.diff(c, axis=0)) and len(signal.mean_normalized(c[:0])) == 0


def test_sessions(spark, tmp_path):
    store = sessions.Sessions(spark, str(tmp_path / "sessions"))
    assert store.list().count() == 0 and store.load("x").count() == 0
    schema = "meeting_id string, title string, meeting_date date, duration_ms long, speaker_labels array<string>, action_items array<string>, low_confidence long, keywords array<struct<rank:int,word:string>>"
    row = lambda m, t: (m, t, None, 5, ["a", "b"], ["x"], None, [(i, f"w{i}") for i in range(7)])
    store.save(spark.createDataFrame([row("a/b", "one"), row("c", "two")], schema))
    store.save(spark.createDataFrame([row("a/b", "three"), row("a/b", "four")], schema))
    got = {r.id: r for r in store.list().collect()}
    assert set(got) == {"a_b", "a_b-1", "a_b-2", "c"} and got["c"].keywords == ["w0", "w1", "w2", "w3", "w4"] and got["c"].low_confidence == 0
    assert [r.id for r in store.list().collect()][:2] == ["a_b-2", "a_b-1"]
    assert json.loads(store.load("a/b").first().snapshot)["title"] == "one"
    store.remove("a/b")
    store.remove("nobody")
    assert {r.id for r in store.list().collect()} == {"a_b-1", "a_b-2", "c"} and store.load("a_b").count() == 0
    store.save(spark.createDataFrame([row("a/b", "five")], schema), F.lit("c"))
    assert {r.id for r in store.list().collect()} == {"a_b-1", "a_b-2", "c", "c-1"}
    store.save(spark.createDataFrame([row("d-3", "six")], schema))
    store.save(spark.createDataFrame([row("d", "seven"), row("d", "eight")], schema))
    assert {r.id for r in store.list().collect()} >= {"d-3", "d", "d-4"}
    store.clear()
    assert store.list().count() == 0


def test_tables(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("# c\n排期\t8\tn\r\n排期\t2\nbad\n会\t-3\nx\ty\n" + "长" * 13 + "\t5\n")
    base = tables.lexicon_entries(spark, str(tmp_path / "lex.txt"))
    assert rows(base, "word", "freq") == [("会", 1.0), ("排期", 2.0), ("排期", 8.0)]
    lex = {r.word: r.log_prob for r in tables.lexicon(base).collect()}
    assert lex["排期"] == pytest.approx(math.log(2 / 11))  # the last line of a word counts, the sum takes both
    (tmp_path / "more.txt").write_text("会\t5\n排期\t1\n新词\t11\n")
    lex = {r.word: r.log_prob for r in tables.lexicon(base, tables.lexicon_entries(spark, str(tmp_path / "more.txt"), 16)).collect()}
    assert lex == {"排期": pytest.approx(math.log(2 / 11)), "会": pytest.approx(math.log(5 / 11)), "新词": pytest.approx(0)}
    (tmp_path / "stop.txt").write_text("的\n# x\n\n 了 \n")
    assert rows(tables.stopwords(spark, str(tmp_path / "stop.txt")), "word") == [("了",), ("的",)]
    (tmp_path / "t2s.txt").write_text("過\t过\nab\tc\n")
    assert tables.character_map(spark, str(tmp_path / "t2s.txt")) == {"過": "过"}
    (tmp_path / "s.txt").write_text("# c\none\n\ntwo\n")
    assert rows(tables.script(spark, str(tmp_path / "s.txt")), "line_no", "text") == [(0, "one"), (1, ""), (2, "two")]
    with pytest.raises(ValueError):
        tables.strict_json("[" * 70 + "]" * 70)
    assert DEFAULT.window == 5 and isinstance(pd.DataFrame(), pd.DataFrame)


@pytest.mark.parametrize("most", [1, 40, 1 << 18])
def test_sentence_pairs_are_made_within_the_meeting(spark, monkeypatch, most):
    """The summary sends sentences, not a row for each pair and shared word, and its links are those of sentence_edges."""
    monkeypatch.setattr(rank, "PAIRS", most)
    rng = random.Random(3)
    said = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(9))] for _ in range(40)]
    df = spark.createDataFrame([("m", i, f"s{i}", x) for i, x in enumerate(said)], "meeting_id string, sent_idx int, text string, tokens array<string>")
    a, b, w = rank.shared_words(pa.array(said, pa.list_(pa.string())))
    want = rows(rank.sentence_edges(df), "src", "dst", "w")
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [r[:2] for r in want] and w.tolist() == pytest.approx([r[2] for r in want])
    assert "Join" not in rank.summary(df)._jdf.queryExecution().optimizedPlan().toString()
