import random
import tracemalloc

import pyarrow as pa
import pytest
from parley.llm import nearcopies
from test_simhash import TEXTS, brute_fingerprint


def shingled(text, k=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_roots(texts):
    """The least index that links of Jaccard similarity 0.8 reach, over all pairs."""
    sets, root = [shingled(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def make(seed):
    """Chains of edits on both sides of similarity 0.8, texts that share a long passage, and short and blank ones."""
    rng, words = random.Random(seed), [f"w{i}" for i in range(400)]
    texts, passage = list(TEXTS), [rng.choice(words) for _ in range(60)]
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 60, 100, 200]))] + passage * (g % 4 == 0)
        texts.append(" ".join(base))
        for _ in range(4):
            for _ in range(rng.randint(1, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
    for _ in range(4):  # many copies of one text, each with edits of its own
        base = [rng.choice(words) for _ in range(100)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randint(1, 5)):
                own[rng.randrange(100)] = rng.choice(words)
            texts.append(" ".join(own))
    return texts + [texts[20].upper(), "one", "one two", "One TWO"]


@pytest.mark.parametrize("bits", [nearcopies.BLOCK_BITS, 8])
def test_stage_keeps_the_first_of_each_exact_component(spark, monkeypatch, bits):
    """Also where so many shingles share each counter that the sketch tells nothing."""
    monkeypatch.setattr(nearcopies, "BLOCK_BITS", bits)
    monkeypatch.setattr(nearcopies, "MOST_BITS", max(bits, 9))
    texts = make(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in nearcopies.first_copies(docs).collect())
    assert got == sorted(set(brute_roots(texts)))


def test_one_word_of_sixty_is_a_near_copy_beyond_three_bits(spark):
    """Of 60 words one changes: similarity 51 / 61, but the fingerprints of three words differ in more than 3 bits."""
    rng = random.Random(5)
    rows = []
    while len(rows) < 40:
        a = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        b = [*a[:30], "other", *a[31:]]
        if (brute_fingerprint(" ".join(a)) ^ brute_fingerprint(" ".join(b))).bit_count() > 3:
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = nearcopies.first_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 40, 2))


def test_empty_table(spark):
    assert nearcopies.first_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_that_repeat_and_columns_that_clash(spark):
    """Different texts under one id all stay; of rows alike one stays; null ids are group members that come last."""
    rows = [(1, "a b c d e f", "x"), (1, "g h i j k l", "x"), (1, "m n o p q r", "y"), (1, "a b c d e f", "x"), (None, "a b c d e f", "n"), (None, "s t u v w x", "z"), (None, "s t u v w x", "z"), (2, None, "e"), (3, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").selectExpr("*", "node as root", "node as first", "node as row", "node as fp")
    got = sorted(tuple(r)[:3] for r in nearcopies.first_copies(docs).where("doc_id is not null").collect())
    assert got == [(1, "a b c d e f", "x"), (1, "g h i j k l", "x"), (1, "m n o p q r", "y"), (2, None, "e")]
    assert [tuple(r) for r in nearcopies.first_copies(docs).where("doc_id is null").collect()] == [(None, "s t u v w x", *"zzzzz")]


def test_counting_shingles_needs_little_memory_and_loses_none():
    """A task counts by 4 bytes a shingle and sends blocks a few at a time; counts are those of all its distinct texts."""
    texts = [" ".join(f"{i} {j}" for j in range(20_000)) for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"node": list(range(len(texts))) + [0], "text": texts + texts[:1]})
    tracemalloc.start()
    total, most = 0, 0
    for b in nearcopies.counted(iter([batch]), nearcopies.MOST_BITS):
        total += sum(int(nearcopies.unplaned(n).sum()) for n in b.column("n").to_pylist())
        most = max(most, b.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    powers = nearcopies.Powers(int(nearcopies.ODD[0]))
    assert total == sum(len(nearcopies.shingle_set(t.encode(), powers)) for t in texts) > nearcopies.COUNTED
    assert most <= nearcopies.SENT and peak < 100e6


def test_texts_are_cut_and_counted_in_one_process(spark):
    """Two Python steps in a row are two processes a task, each with its own memory."""
    plans = []
    docs = spark.createDataFrame([(i, f"a b c d e f g {i}") for i in range(9)], "node long, text string")
    seen = type(docs).repartition
    keep = lambda self, *a: plans.append(self._jdf.queryExecution().executedPlan().toString()) or seen(self, *a)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(docs), "repartition", keep)
        nearcopies.commonness(docs)
    assert len(plans) == 1 and plans[0].count("MapInArrow") == 1


def test_pairs_of_a_large_group_grow_with_its_rows(spark, monkeypatch):
    """Many texts are near copies of a tenth of their group and of no others, so that neighbours rarely are."""
    rng, size = random.Random(7), 600
    texts = []
    for i in range(size):
        own = [f"w{j}" for j in range(199)] + [f"last{i}"]
        for at in rng.sample(range(5, 190, 5), 4 if i % 10 else 0):
            own[at] = f"edit{i}at{at}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, plain = [], type(docs).mapInArrow

    def kept(self, func, schema, *more):
        out = plain(self, func, schema, *more)
        if schema == "a long, b long" and "root" in self.columns:
            made.append(out)
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", kept)
    got = sorted(r.doc_id for r in nearcopies.first_copies(docs).collect())
    assert got == sorted(set(brute_roots(texts)))
    sets = [shingled(t) for t in texts]
    close = sum(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert close > 30_000 and 0 < sum(m.count() for m in made) < 50 * size


def test_pairs_that_a_round_leaves_out_are_told():
    """Of each bucket a row is in few pairs; buckets with pairs left over are named, until all pairs came."""
    rows = {"h": [1] * 30 + [2] * 2, "n": [20] * 32, "node": list(range(32)), "root": list(range(30)) + [5, 6], "bits": [[0] * 16] * 32}
    batch = pa.RecordBatch.from_pydict(rows, pa.schema([("h", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("root", pa.int64()), ("bits", pa.list_(pa.int64()))]))
    for most in (2, 8, 32):
        pairs = [p for a, b in nearcopies.some_pairs(iter([batch]), most) for p in zip(a.tolist(), b.tolist(), strict=True)]
        told, pairs = [a for a, b in pairs if a == b], [p for p in pairs if p[0] < p[1]]
        assert (30, 31) in pairs and len(pairs) == len(set(pairs))
        assert told == ([] if most == 32 else [1])
        assert len(pairs) == 1 + 30 * 29 // 2 if most == 32 else len(pairs) <= 30 * (most + 1) // 2 + 1
