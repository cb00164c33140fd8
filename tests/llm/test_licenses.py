import math
import re
from collections import Counter

from parley.llm import licenses as li


def brute_lines(files, least=li.LEAST):
    """(path, line) -> (license, score), all lines against all templates."""
    tok = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    total = len(files)
    df = Counter(t for _, text in files for t in set(tok(text)))
    vocab = {t for own in li.vocabulary(li.TEMPLATES).values() for t in own}
    idf = lambda t: math.log((1 + total) / (1 + df[t])) + 1 if t in vocab else math.log(1 + total) + 1
    vec = lambda ts: {t: n * idf(t) for t, n in Counter(ts).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for path, text in files:
        for i, line in enumerate(re.split("\r\n|\r|\n", text or "")):
            v = vec(tok(line))
            if not v:
                continue
            best = min((-round(sum(v.get(t, 0) * x for t, x in w.items()) / norm(v) / norm(w), 9), name) for name, forms in li.TEMPLATES.items() for w in (vec(tok(f)) for f in forms))
            if -best[0] >= least:
                out[path, i] = (best[1], -best[0])
    return out


FILES = [
    ("a/LICENSE", "Released under the MIT License."),
    ("a/b/x.txt", "some prose about the general public\nand this is all"),
    ("a/b/c/y.txt", "line one of it\nLicensed under the Apache License, Version 2.0\r\nmore"),
    ("a/b/c/d/z.txt", "nothing here"),
    ("a/b/c/COPYING.md", "All rights reserved."),
    ("q/z.txt", "nothing here"),
    ("top.txt", "This work is licensed under the GNU General Public License, version 3. " + "word " * 40),
    ("n.txt", None),
    ("e/e.txt", ""),
    (None, "Licensed under CC BY-NC 4.0."),
    ("long.txt", "filler words\n" * 3000 + "Licensed under CC BY 4.0."),
    ("a/LICENSE", "Released under the MIT License."),
]


def test_lines_equal_brute_force(spark):
    got = {(r.path, r.line): (r.license, r.score) for r in li.license_lines(spark.createDataFrame(FILES, "path string, text string")).collect()}
    want = brute_lines(FILES)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_nearest_directory(spark):
    df = spark.createDataFrame([(*f, "x") for f in FILES], "path string, text string, license string")
    rows = li.scan(df).collect()
    assert len(rows) == len(FILES)
    got = {r.path: (r.license, r.license_from) for r in rows}
    assert got["a/b/x.txt"] == ("MIT", "a/LICENSE") and got["a/LICENSE"] == ("MIT", "a/LICENSE")
    assert got["a/b/c/y.txt"] == ("Apache-2.0", "a/b/c/y.txt")
    assert got["a/b/c/d/z.txt"] == ("proprietary", "a/b/c/COPYING.md")
    assert got["q/z.txt"] == (None, None) and got["n.txt"] == (None, None) and got["e/e.txt"] == (None, None)
    assert got["long.txt"][0] == "CC-BY-4.0"


def test_common_words_weigh_little(spark):
    """Words that most files hold don't hide a notice, however many files there are."""
    files = [(f"{i}.txt", f"river stone cloud n{i}") for i in range(400)] + [("x.txt", "Released under the MIT License. river stone cloud")]
    got = li.license_lines(spark.createDataFrame(files, "path string, text string")).collect()
    assert [(r.path, r.license) for r in got] == [("x.txt", "MIT")] and got[0].score > 0.9


def test_empty_table(spark):
    assert li.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_scan_keeps_other_columns(spark):
    rows = [("a/LICENSE", "Released under the MIT License.", "k", "f", "m"), ("a/b.txt", "some text", "k", "f", "m"), (None, None, "k", "f", "m")]
    files = spark.createDataFrame(rows, "path string, text string, __key string, folder string, mine string")
    got = li.scan(files)
    assert got.columns == [*files.columns, "license", "license_score", "license_from"]
    assert {(r["path"], r["__key"], r["folder"], r["mine"], r["license"]) for r in got.collect()} == {("a/LICENSE", "k", "f", "m", "MIT"), ("a/b.txt", "k", "f", "m", "MIT"), (None, "k", "f", "m", None)}
