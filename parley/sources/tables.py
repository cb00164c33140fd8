"""Readers of lexicons, stop words, character maps, scripts, reviewed transcripts and sessions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions.chinese import Lexicon
from ..functions.text import trim


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line")).where("line not like '#%' and trim(line) <> ''")


def lexicon_entries(spark: SparkSession, path: str, longest: int = 12) -> DataFrame:
    """word, freq, line_no of lines `word<TAB>freq[<TAB>part of speech]`; bad lines go, frequencies from 0 down count as 1.

    A lexicon is a dictionary of bounded size: each file is read as one row, which keeps its lines' order.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where("line not like '#%'")
    parts = F.split("line", "\t")
    rows = lines.where(F.size(parts) >= 2).select("line_no", parts[0].alias("word"), F.expr("try_cast(trim(split(line, '\t')[1]) as double)").alias("freq"))
    rows = rows.where((F.col("word") != "") & F.col("freq").isNotNull() & (F.length("word") <= longest))
    return rows.select("word", F.when(F.col("freq") > 0, F.col("freq")).otherwise(1.0).alias("freq"), "line_no")


def lexicon(base: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """word, log_prob over the sum of the base's frequencies.

    Of a word that repeats in the base its last line counts, though the sum takes each; an extra entry adds a word or
    raises its probability, and the sum takes none of them.
    """
    total = base.agg(F.greatest(F.sum("freq"), F.lit(1.0)).alias("total"))
    rows = base.groupBy("word").agg(F.max_by("freq", "line_no").alias("freq"))
    rows = (rows if extra is None else rows.unionByName(extra.select("word", "freq"))).crossJoin(F.broadcast(total))  # one row
    return rows.groupBy("word").agg(F.max(F.log("freq") - F.log("total")).alias("log_prob"))


def lexicon_model(table: DataFrame, total: float) -> Lexicon:
    """The lexicon for the tokenizer: a dictionary's words, sent to each Python worker once."""
    return Lexicon({r.word: r.log_prob for r in table.collect()}, total)


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(trim(F.col("line")).alias("word")).distinct()


def character_map(spark: SparkSession, path: str) -> dict[str, str]:
    """from -> to of lines with one character each; an empty table is an error."""
    parts = F.split("line", "\t")
    rows = _lines(spark, path).where(F.size(parts) >= 2).select(parts[0].alias("a"), parts[1].alias("b")).where("length(a) = 1 and length(b) = 1").collect()
    if not rows:
        raise ValueError(f"no pairs of characters in {path}")
    return {r.a: r.b for r in rows}


def script(spark: SparkSession, path: str) -> DataFrame:
    """line_no, text of a replay script: one line a recognised unit, a blank one is silence, # comments go."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split(F.regexp_replace("value", "\r|\n$", ""), "\n"), lambda s: ~s.startswith("#"))).alias("line_no", "text"))
    return rows.select("line_no", trim(F.col("text")).alias("text"))


def build_lexicon(words: DataFrame, least: float = 5, longest: int = 12) -> DataFrame:
    """word, freq fit for a lexicon: frequent, short, of CJK or ASCII word characters, not digits alone."""
    good = (F.col("freq") >= least) & (F.length("word") <= longest) & F.col("word").rlike("^[一-鿿A-Za-z0-9]+$") & ~F.col("word").rlike("^[0-9]+$")
    return words.where(good)


REVIEWED = "title string, meetingDate string, quality struct<durationMs:bigint>, speakerLabels array<string>, asr struct<language:string, segments:array<struct<startMs:bigint,endMs:bigint,text:string,speakerId:int>>>"


def reviewed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(meetings, segments) of reviewed transcripts in JSON files; absent fields have defaults."""
    rows = spark.read.schema(REVIEWED).option("multiLine", "true").json(path).withColumn("meeting_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1))
    meetings = rows.select("meeting_id", F.coalesce("title", F.lit("")).alias("title"), F.try_to_date("meetingDate", "yyyy-MM-dd").alias("meeting_date"), F.coalesce("speakerLabels", F.array().cast("array<string>")).alias("speaker_labels"), F.coalesce("quality.durationMs", F.lit(0)).alias("duration_ms"))
    segments = rows.select("meeting_id", F.posexplode("asr.segments").alias("seg_idx", "s")).select("meeting_id", "seg_idx", F.col("s.startMs").alias("start_ms"), F.col("s.endMs").alias("end_ms"), F.coalesce("s.text", F.lit("")).alias("text"), F.coalesce("s.speakerId", F.lit(-1)).alias("speaker_id"))
    return meetings, segments


def sessions(rows: DataFrame) -> DataFrame:
    """The newest snapshot of each id, newest first in rank."""
    last = W.partitionBy("id").orderBy(F.col("created_at").desc())
    newest = rows.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    return newest.orderBy(F.col("created_at").desc(), F.col("id").desc())


def strict_json(text: str):
    """Strict JSON of bounded depth and size; raises ValueError."""
    if len(text) > 64 << 20:
        raise ValueError("too large")
    depth = 0
    out = json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    level = [out]
    while level:
        depth += 1
        if depth > 64:
            raise ValueError("too deep")
        level = [y for x in level for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()) if isinstance(y, (dict, list))]
    return out
