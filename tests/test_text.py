from pyspark.sql import functions as F

from parley.config import Config
from parley.functions import text as tx


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_strings(spark):
    assert column(spark, [" \t\x0ba b\n", "", None], tx.trim) == ["a b", "", None]
    assert column(spark, ["ÀbC"], tx.lower_ascii) == ["Àbc"] and column(spark, ["àbC"], tx.upper_ascii) == ["àBC"]
    assert column(spark, ["ＡＢＣ１２３　！"], tx.half_width) == ["ABC123 !"]
    assert column(spark, ["a,b;;c"], lambda c: tx.split_any(c, ",;")) == [["a", "b", "c"]]
    assert column(spark, [" a \n\n b"], tx.split_lines) == [["a", "b"]]
    assert column(spark, ["7", "1234"], lambda c: tx.pad_left(c, 3, "0")) == ["007", "1234"]
    assert column(spark, ["<a href=\"x\">'&"], tx.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;"]
    assert column(spark, ["a|b\nc"], tx.markdown_cell) == ["a\\|b c"]
    assert column(spark, ["a/b:c", "...", "con.txt", " x. ", ".hidden"], tx.safe_name) == ["a_b_c", "untitled", "untitled_con.txt", "x", "hidden"]
    assert column(spark, [1.5, 2.0, -0.0, float("nan"), 0.126], lambda c: tx.number_string(c, 2), "double") == ["1.5", "2", "0", "0", "0.13"]
    assert column(spark, ["排期😀"], lambda c: tx.convert_characters(c, {"排": "徘"})) == ["徘期😀"]


def test_classes(spark):
    assert column(spark, ["排期", "3.5", "a1", "，", "好，", "--"], tx.is_content) == [True, False, True, False, False, False]
    assert column(spark, ["hello. v2.0... a--"], tx.ascii_tokens) == [["hello", ".", "v2.0", ".", ".", ".", "a", "-", "-"]]
    assert column(spark, ["今天开会。明天继续！可以吗？最后总结一下；结束"], tx.sentences) == [["今天开会。", "明天继续！", "可以吗？", "最后总结一下；", "结束"]]
    assert column(spark, ["v2.0好", "他说“好。”走了"], tx.sentences) == [["v2.", "0好"], ["他说“好。”", "走了"]]
    assert column(spark, ["[BLANK_AUDIO]", " (silence)", "hello"], tx.blank_speech) == [True, True, False]
    assert column(spark, ["产品评审会今天开始。后续讨论排期。", "", "好。"], lambda c: tx.title(c, F.lit("会议"))) == ["产品评审会今天开始", "会议", "会议"]


def test_rules(spark):
    assert column(spark, ["我们决定采用方案A", "这个方案通过了", "我不同意这个做法", "今天天气不错"], tx.decision_kind) == ["确定", "通过", "否决", None]
    assert column(spark, ["请尽快处理", "必须今天完成", "有空可以看一下", "周五前提交"], tx.priority) == ["高", "高", "低", "中"]
    assert column(spark, ["请张三负责", "好吗？请"], tx.action_trigger) == ["负责", "请"]
    assert column(spark, [0, 2, 10, 100], lambda c: tx.target_sentences(c, 0.5, 3, 12), "int") == [0, 2, 5, 12]
    assert column(spark, [100], lambda c: tx.target_sentences(c, 0.01, 1, 3), "int") == [1]


def test_times(spark):
    assert column(spark, [3723004, -5, 360000000], tx.duration, "long") == ["01:02:03", "00:00:00", "100:00:00"]
    assert column(spark, [3723004], tx.srt_time, "long") == ["01:02:03,004"] and column(spark, [3723004], tx.clock, "long") == ["01:02:03.004"]
    assert column(spark, [3723004], tx.short_time, "long") == ["62:03"]
    assert [str(d) for d in column(spark, ["2026-9-14", "2026/02/30", "1800-01-01", "x", "2026.10.8"], tx.parse_date)] == ["2026-09-14", "None", "None", "None", "2026-10-08"]
    assert column(spark, ["2026-09-14"], lambda c: tx.weekday_name(F.to_date(c))) == ["星期一"]
    assert column(spark, [1001], lambda c: tx.samples_to_ms(c, F.lit(16000)), "long") == [62] and column(spark, [63], lambda c: tx.ms_to_samples(c, F.lit(16000)), "long") == [1008]


def test_speakers(spark):
    labels = F.array(F.lit("甲"))
    assert column(spark, [-1, 0, 3], lambda c: tx.speaker_label(c, labels), "int") == ["未识别", "甲", "说话人4"]
    assert column(spark, [1, 3], tx.speaker_labels, "int") == [["发言人"], ["说话人1", "说话人2", "说话人3"]]


def test_config():
    c = Config.from_json('{"window": 7, "alpha": 0.5, "unknown": 1, "max_topics": "x"}')
    assert (c.window, c.alpha, c.max_topics) == (7, 0.5, 12) and Config.from_json(c.to_json()) == c
    assert Config(summary_ratio=2.0).problems() and not Config().problems()
