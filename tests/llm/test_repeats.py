import hashlib
import random
from collections import Counter

import pytest

from parley.llm import repeats, substring, suffix


def brute(texts, window, split, join):
    """(units, removed, runs, digest) of each text, every window counted."""
    seqs = [split(t or "") for t in texts]
    count = Counter(tuple(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if count[tuple(s[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(s), sum(gone), runs, hashlib.sha256(join([x for x, g in zip(s, gone) if not g])).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "bé", "the", "ünder", "x\u0085y", "日本", "of", "c,"] + [f"w{i}" for i in range(60)]
    gaps = [" ", "  ", "\n", "\t", " \x0b", "\x0c"]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    glue = lambda ws: "".join(w + rng.choice(gaps) for w in ws)
    passages = [make(n) for n in (3, 10, 12, 25, 60)]
    texts = []
    for _ in range(60):
        body = make(rng.randrange(0, 60))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = p if rng.random() < 0.6 else p[rng.randrange(len(p)) :]
        texts.append(glue(body))
    texts += [" ".join(passages[4])] * 3 + [texts[5], texts[5] + "x", "z" * 300, "ab" * 150, "word " * 90, " ".join(make(20)) * 4, "", None, "short", " \n ", " ".join(passages[3]) + " \0 \0"]
    base = make(50)
    for _ in range(40):  # near copies
        near = list(base)
        near[rng.randrange(50)] = rng.choice(words)
        texts.append(" ".join(near))
    return texts


@pytest.mark.parametrize("hot,held,piece,most", [(128, 1 << 18, 1 << 19, 27), (3, 40, 97, 27), (2, 1 << 18, 1 << 19, 27), (128, 1 << 18, 1 << 19, 0), (3, 40, 97, 0)])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, hot, held, piece, most, seed):
    """Whatever counts as hot, and whether the sketch is sent (most 27) or anchors are counted (most 0)."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "MOST_BITS", most)
    monkeypatch.setattr(repeats, "HELD", held)
    monkeypatch.setattr(repeats, "PIECE", piece)
    texts = corpus(seed)
    rows = [(i, t, "e") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: r for r in suffix.digest(suffix.dedup_bytes(docs, 40)).collect()}
    want = brute(texts, 40, str.encode, bytes)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want
    got = {r.doc_id: r for r in substring.digest(substring.dedup_words(docs, 9)).collect()}
    want = brute(texts, 9, lambda t: t.encode().split(), b" ".join)
    assert [(got[i].n_words, got[i].n_removed, got[i].kept_sha256) for i in range(len(texts))] == [(a, b, d) for a, b, _, d in want]


def test_interval_tree():
    array = ["aabc", "aac", "b", "ba", "bb"]
    common = [suffix.common_prefix(a.encode(), b.encode()) for a, b in zip(array, array[1:])]
    assert common == [3, 2, 0, 1, 1]
    assert set(suffix.prefix_intervals(common)) == {(3, 0, 1), (2, 0, 2), (1, 3, 5), (0, 0, 5)}


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring.dedup_words(docs, 3).collect()) == [0, 6, 6]
    assert suffix.dedup_bytes(docs.limit(0)).count() == 0


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    """Counters that all count twice send every window, and decide nothing."""
    docs = spark.createDataFrame(list(enumerate(corpus(3))), "doc_id long, text string")
    whole = [sorted(map(tuple, f.collect())) for f in (suffix.digest(suffix.dedup_bytes(docs, 40)), substring.digest(substring.dedup_words(docs, 9)))]
    monkeypatch.setattr(repeats.Sketch, "at_least", lambda self, bits, h: repeats.np.full(len(h), bits is self.twice))
    assert [sorted(map(tuple, f.collect())) for f in (suffix.digest(suffix.dedup_bytes(docs, 40)), substring.digest(substring.dedup_words(docs, 9)))] == whole


@pytest.mark.parametrize("hot", [128, 2])
def test_words_that_polynomials_confuse_are_told_apart(spark, monkeypatch, hot):
    """A Thue-Morse word of 1024 letters and its mirror have one hash under any polynomial modulo 2**64."""
    monkeypatch.setattr(repeats, "HOT", hot)
    morse = [i.bit_count() & 1 for i in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in morse) for flip in (0, 1))
    words = [f"w{i}" for i in range(34)]
    texts = [" ".join([*words, one]), " ".join([*words, other]), *(" ".join([*words[5:], f"x{i}"]) for i in range(180))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.n_removed for r in substring.dedup_words(docs).collect()} == {0}


def test_other_columns_keep_their_names_and_values(spark):
    names = ["__copies", "__k1", "__t1", "copies", "spans", "own1", "key1", "N_Words"]
    rows = [(i, "a b c d e f" if i < 2 else "x", *(f"{n}{i}" for n in names)) for i in range(3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    for f, removed in ((substring.dedup_words, 6), (suffix.dedup_bytes, 11)):
        got = sorted(f(docs, 3).collect(), key=lambda r: r["doc_id"])
        assert [r["n_removed"] for r in got] == [removed, removed, 0]
        assert all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names[:-1])
    assert "N_Words" not in substring.dedup_words(docs, 3).columns and "N_Words" in suffix.dedup_bytes(docs, 3).columns


def test_very_long_texts(spark):
    """Texts of many pieces: one passage at both ends of each, and nothing else repeats."""
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(10**9)}" for _ in range(40))
    body = [" ".join(f"{i}w{rng.randrange(10**9)}" for _ in range(120000)) for i in range(2)]
    docs = spark.createDataFrame([(i, f"{passage} {b} {passage}") for i, b in enumerate(body)], "doc_id long, text string")
    assert [(r.n_words, r.n_removed) for r in substring.dedup_words(docs).orderBy("doc_id").collect()] == [(120080, 80)] * 2
    got = suffix.digest(suffix.dedup_bytes(docs)).collect()
    assert all(2 * len(passage) <= r.n_removed <= 2 * len(passage) + 6 and r.n_spans == 2 for r in got)
