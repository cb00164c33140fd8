"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, licenses, substring, suffix, toxicity
from .common import held_out, read
from .decontamination import decontaminate
from .mixing import mix
from .simhash import simhash_components
from .topk import top_k
from .urls import judge


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.label(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.dedup_bytes(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.dedup_words(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(licenses.document_paths(read(spark, sf_dir, "documents")))
    return found.select("doc_id", "path", "license", "license_score", "license_from")


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_language_id": op2_language_id,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_simhash_neardup": op7_simhash_neardup,
    "op8_toxicity": op8_toxicity,
    "op9_url_filter": op9_url_filter,
    "op10_exact_topk": op10_exact_topk,
}

ORACLES: dict[str, str] = {
    "op4_suffix_array_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        l AS (SELECT r, list_transform(range(0, len(h) // 2 - 199), lambda i: md5_number(substr(h, 2 * i + 1, 400))) AS l FROM d),
        w AS (SELECT r, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS s FROM l),
        hit AS (SELECT r, i FROM w SEMI JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) USING (s)),
        mark AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM hit),
        run AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM mark),
        span AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY r, k),
        gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM span),
        kept AS (
            SELECT r, count(*) AS n, sum(b - a) AS gone, max(b) AS z, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS k
            FROM gap JOIN d USING (r) GROUP BY r
        )
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
            sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)
    """,
    "op5_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT r, list_transform(range(1, len(w) - 33), lambda i: md5_number(array_to_string(w[i:i + 34], ' '))) AS l FROM d),
        win AS (SELECT r, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM l),
        hit AS (SELECT r, i FROM win SEMI JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) USING (s)),
        gone AS (SELECT DISTINCT r, i + k AS j FROM hit, unnest(range(0, 35)) AS u(k)),
        words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
        kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS k FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)
    """,
    "op10_exact_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rk FROM p)
        SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 5
    """,
}
