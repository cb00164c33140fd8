import random
import re
from collections import Counter

from parley.llm import decontamination as d


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def shingles(ws, k):
    return [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        for item_id, item in items:
            iw = words(item)
            if not iw:
                continue
            k = min(5, len(iw))
            own, other = shingles(words(text), k), Counter(shingles(iw, k))
            m, best = sum(other.values()), (0, 0)
            for s in range(len(own)):
                w = Counter(own[s : s + m])
                both = sum((w & other).values())
                best = max(best, (both / (sum(w.values()) + m - both), -s))
            if best[0] >= 0.8:
                out[doc_id, item_id] = (round(best[0], 9), -best[1])
    return out


def test_equals_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "né") for b in "abcdefghijklmnop"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(12, 60)))) for i in range(25)]
    items += [(90, "tiny one"), (91, ""), (92, None), (93, "x y z " * 8), (94, items[0][1])]
    docs = []
    for i in range(80):
        ws = [rng.choice(vocab) for _ in range(rng.randrange(0, 150))]
        if i % 2:
            part = items[rng.randrange(25)][1].split()
            if i % 4 == 1 and len(part) > 45:
                part[0] = "changed"
            if i % 8 == 3:
                part = part[: int(len(part) * rng.choice([0.5, 0.9, 0.97]))]
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = part
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(ws).upper() if i % 3 else "  ".join(ws)))
    docs += [(100, None), (101, ""), (102, "so TINY, one!"), (103, "x y z " * 9), (104, docs[1][1]), (105, items[3][1])]
    df = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, similarity double").repartition(3)
    bench = spark.createDataFrame([(*r, "a") for r in items], "item_id long, text string, source string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in d.decontaminate(df, bench).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 30
    kept = {r.doc_id for r in d.clean(df, bench).collect()}
    assert kept == {r[0] for r in docs} - {k[0] for k in want}


def test_simhash_is_the_majority(spark):
    rng = random.Random(3)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (1, 2, 3, 40)]
    df = spark.createDataFrame(rows, "h array<long>")
    for r in df.select("h", d.simhash(df["h"]).alias("fp")).collect():
        assert r.fp % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r.h) > len(r.h))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert d.decontaminate(docs, items.limit(0)).count() == 0 and d.clean(docs, items.limit(0)).count() == 1
    assert d.decontaminate(docs.limit(0), items).count() == 0 and d.clean(docs.limit(0), items).count() == 0


def test_clean_keeps_other_columns(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item, "a", "b", "c"), (2, "other words here", "a", "b", "c"), (3, None, "a", "b", "c"), (3, None, "a", "b", "c")], "doc_id long, text string, __t1 string, t1 string, own1 string")
    got = d.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == sorted([(2, "other words here", "a", "b", "c"), (3, None, "a", "b", "c"), (3, None, "a", "b", "c")], key=str)
    assert d.clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == 4
