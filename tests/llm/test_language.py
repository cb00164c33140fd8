import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import language
from parley.llm.common import held_out

PARTS = {"aa": ["ka", "ko", "ki", "ku"], "bb": ["lo", "le", "la", "li"], "ру": ["ба", "бо", "до", "да"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, lang, 60), lang) for i, lang in enumerate(list(PARTS) * 60)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "123 $$$ \n", "bb"), (None, prose(rng, "aa", 9), "bb"), (1003, prose(rng, "aa", 40) + " " + prose(rng, "bb", 25), None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_documents(docs):
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.label(docs, model, with_spans=True).withColumn("held", held_out(F.col("doc_id"))).collect()}
    assert len(got) == docs.count()
    assert all(r.lang_pred == r.lang for r in got.values() if r.held and r.doc_id is not None and r.doc_id < 1000)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1001].score == 0
    mixed = got[1003]
    assert mixed.lang_pred == "aa" and 0.5 < mixed.score < 0.8 and [s.lang for s in mixed.lang_spans] == ["aa", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_scripts_narrow_the_candidates(docs):
    model = language.fit(docs)
    first, n, scores = language.words("да зз", model)
    other = [i for i, name in enumerate(model.languages) if name != "ру"]
    assert (scores[1, other] < scores[1, model.languages.index("ру")] - 10).all()


def test_nothing_learnt_and_empty_table(spark, docs):
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) lang", "1 as SCORE")
    assert {r.lang_pred for r in language.label(bare, language.fit(bare)).collect()} == {"und"}
    assert language.label(docs.limit(0), language.fit(docs)).count() == 0


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    scores = [rng.normal(0, 3, (n, 3)) for n in (6, 0, 3, 6, 1)]
    for s, path in zip(scores, language.viterbi(scores, 2.0), strict=True):
        total = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731,B023
        best = max((total(p) for p in np.ndindex(*[3] * len(s))), default=0)
        assert total(path) == pytest.approx(best) and len(path) == len(s)


def test_chunks_change_nothing(docs, monkeypatch):
    model = language.fit(docs)
    text = "ka lo " + "kakoki" * 40 + " lo-le  da1da " * 30
    whole = language.words(text, model)
    monkeypatch.setattr(language, "CHUNK", 300)
    for a, b in zip(whole, language.words(text, model), strict=True):
        assert np.allclose(a, b)


def test_two_hundred_languages(spark):
    """Labels beyond 127 are labels like any other."""
    rows = [(i, chr(0x4E00 + i % 200) * 3 + " " + chr(0x4E00 + i % 200) * 5, f"l{i % 200:03d}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.label(docs, language.fit(docs)).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got) and len({r.lang_pred for r in got}) > 180
