import random

import pytest
import xxhash

from parley.llm import simhash


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=3):
    """rows: (doc_id, fp); the smallest id reachable, by plain search over all pairs."""
    fps = sorted({fp for _, fp in rows})
    seen, of = set(), {}
    for fp in fps:
        if fp in seen:
            continue
        group, queue = {fp}, [fp]
        while queue:
            x = queue.pop()
            for y in fps:
                if y not in group and (x ^ y).bit_count() <= radius:
                    group.add(y)
                    queue.append(y)
        seen |= group
        low = min((d for d, f in rows if f in group and d is not None), default=None)
        of |= dict.fromkeys(group, low)
    return [of[fp] for _, fp in rows]


TEXTS = ["a b", "", None, "  \t\n", "one", "A B c\x0bd  e f", "éÀ Éa", "x " * 50, "the quick brown fox jumps over the lazy dog", " ".join(str(i) for i in range(5000))]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = list(TEXTS)
    for _ in range(40):
        base = [rng.choice(words) for _ in range(150)]
        texts.append(" ".join(base))
        for _ in range(3):
            base[rng.randrange(150)] = rng.choice(words)
            texts.append(" ".join(base))
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(3, TEXTS[3], "x"), (None, "one", "x"), (500, texts[20], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.fp % 2**64, r.component_id) for r in simhash.simhash_components(docs).collect()), key=str)
    plain = [(d, brute_fingerprint(t)) for d, t, _ in rows]
    want = sorted(((d if d is not None else -1, fp, c) for (d, fp), c in zip(plain, brute_components(plain), strict=True)), key=str)
    assert got == want


def test_dense_bucket_is_cut_and_keeps_its_links(monkeypatch):
    import numpy as np

    rng = random.Random(2)
    values = np.unique(np.array([rng.getrandbits(12) << 32 | rng.getrandbits(1) | 1 << 40 for _ in range(900)], np.uint64))
    top = lambda edges: brute_count(len(values), edges)
    whole = top(simhash.forest(values, 3))
    monkeypatch.setattr(simhash, "DIRECT", 10)
    assert top(simhash.bucket_edges(values, 0, 3)) == whole


def brute_count(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return len({find(i) for i in range(n)})


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
