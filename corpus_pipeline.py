"""The corpus pipeline: stages that each read the documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import language, mixing, substring
from parley.llm.common import read, stage
from parley.llm.decontamination import clean
from parley.llm.nearcopies import first_copies

#: Least share of a document's letters in its language; nothing that one language leads is below.
LEAST_SHARE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with the one that they are written in. `und` goes.

    Where no document is labelled, nothing can be learnt, and `und` rejects none that has letters.
    """
    model = language.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.label(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one of the smallest id; repeated and null ids lose no other text.

    Near copies share 0.8 or more of their 5-word shingles; op7's three words and three bits are its own.
    """
    return first_copies(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; texts that lose nothing stay as they are, and emptied ones go."""
    found = substring.dedup_words(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    found = found.where("n_removed < n_words").withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null texts, repeated rows and other columns stay, and an empty benchmark takes nothing."""
    return clean(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each document that the mix takes words of.

    Rows that repeat an id are documents of their own; texts without words go; no documents give no rows.
    """
    return mixing.mix(docs).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are a table in the shared folder that the next one reads."""
    docs = read(spark, sf_dir, "documents")
    for _, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints and models are not SQL; tests/llm/test_pipeline.py checks the run.
ORACLE_SQL = None
