import random

import corpus_pipeline
from test_decontamination import brute as brute_items
from test_repeats import brute as brute_repeats
from test_simhash import brute_components, brute_fingerprint

PARTS = {"aa": ["ka", "ko", "ki", "ku", "ma"], "bb": ["lo", "le", "la", "li", "te"]}


def make(spark, folder):
    """Documents with near copies, shared passages, benchmark items and texts that are no language."""
    rng = random.Random(11)
    word = lambda lang: "".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(2, 4)))
    prose = lambda lang, n: [word(lang) for _ in range(n)]
    items = [" ".join(prose("aa", 40)) for _ in range(3)]
    passage = " ".join(prose("aa", 50))
    docs = []
    for i in range(60):
        lang = rng.choice(list(PARTS))
        ws = " ".join(prose(lang, 120))
        if i % 10 == 3:
            ws += " " + passage
        if i % 20 == 7:
            ws += " " + items[i // 20]
        docs.append((i, ws, lang, f"s{i % 4}", len(ws)))
    docs += [(100, docs[0][1], "aa", "s0", 1), (101, docs[1][1].upper(), None, "s1", 1), (102, "123 456 $$$", "aa", "s1", 1), (103, None, "aa", "s2", None), (104, "", None, None, 0), (0, docs[0][1], "aa", "s0", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return list(enumerate(items))


def test_each_stage_equals_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    items = make(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        made = f(spark, docs, folder)
        made.write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        kept[name] = [r.asDict() for r in docs.collect()]
        ids = sorted(r["doc_id"] for r in kept[name])
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            assert ids == sorted(r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or ""))
        elif i == 1:
            of = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in before])
            assert ids == sorted(set(of)) and 100 not in ids and 101 not in ids
        elif i == 2:
            want = brute_repeats([r["text"] for r in before], 35, lambda t: t.encode().split(), b" ".join)
            left = {r["doc_id"]: len(r["text"].split()) for r in kept[name]}
            assert left == {r["doc_id"]: n - gone for r, (n, gone, _, _) in zip(before, want, strict=True) if n > gone}
            assert any(gone for _, gone, _, _ in want) and all(r["n_chars"] == len(r["text"]) for r in kept[name])
        elif i == 3:
            found = {d for d, _ in brute_items([(r["doc_id"], r["text"]) for r in before], items)}
            assert ids == sorted({r["doc_id"] for r in before} - found) and found
        else:
            sizes = {r["doc_id"]: len(r["text"].split()) for r in before}
            assert all(0 < r["taken"] <= 2 * r["size"] and r["size"] == sizes[r["doc_id"]] for r in kept[name])
            for s in {r["source"] for r in kept[name]}:
                own = [r for r in kept[name] if r["source"] == s]
                assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2
    rerun = {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, folder).collect()}
    assert rerun == {(r["doc_id"], r["taken"]) for r in kept["mixing sources"]}
