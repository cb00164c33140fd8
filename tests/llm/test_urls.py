import random
import re
from collections import Counter, defaultdict

from parley.llm import urls


def plain(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1])
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and m[2].startswith(p)]
    return host, m[2], max(fits)[1:] if fits else None


URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/12", "http://example.org/en/2", "http://example.org", "x", None, "", "://", "http://?q", "http://h.com#f",
    "http://org/", "http://notorg/x", "http://b.com/fr/1?x#y", "http://com/de/", "HTTP://C.COM/De/", "http://ÀB.com/de/é?a://b", "a://b://c/d", "http://x.com/de/1/2/3/4/5/6",
]


def test_host_path_and_rules(spark):
    df = spark.createDataFrame([(i, u, "no") for i, u in enumerate(URLS)] + [(3, URLS[3], "twice"), (None, URLS[0], None)], "page_id long, url string, verdict string")
    got = urls.judge(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, rule = plain(URLS[r.page_id or 0] if r.page_id is not None else URLS[0])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict == (rule[1] if rule else r.verdict) and r.verdict in ("allow", "block")


def test_templates_learn_from_labelled_pages(spark):
    """Pages of /de/ on a host of .com are blocked by rule; the same template on a host without rules is rejected with them."""
    rows = [f"http://a{h}.com/de/{i}" for h in range(4) for i in range(30)] + [f"http://b.net/de/{i}" for i in range(30)] + [f"http://b.net/en/{i}" for i in range(30)] + [f"http://c.org/en/{i}" for i in range(30)]
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"))
    of = {(r.host, r.template): r.verdict for r in got.collect()}
    assert of["b.net", "/de/{n}"] == "block" and of["b.net", "/en/{n}"] == "allow"


def test_rare_segments_become_wildcards(spark):
    rows = [f"http://b.net/item/{chr(97 + i % 26)}{chr(97 + i // 26)}/x" for i in range(200)]
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"))
    assert {r.template for r in got.collect()} == {"/item/*/x"}


def apart(n, b, all_n, all_b):
    p = all_b / all_n if all_n else None
    return bool(n and all_n) and abs(b / n - p) > urls.DIFFERS * (p * (1 - p) / n) ** 0.5


def tree(paths):
    """{segments: template} of one host's Counter of (segments, label) pages, one segment after the other."""
    out = {}

    def grow(made, members):  # members: [(segments, rest, Counter of labels)]
        pages = sum(sum(c.values()) for *_, c in members)
        under = defaultdict(list)
        for segs, rest, c in members:
            if pages < urls.LEAST_PAGES:
                out[segs] = (*made, *["*"] * len(rest))
            elif not rest:
                out[segs] = made
            else:
                under[rest[0]].append((segs, rest[1:], c))
        size = {s: sum(sum(c.values()) for *_, c in m) for s, m in under.items()}
        bad = {s: sum(c["block"] for *_, c in m) for s, m in under.items()}
        lab = {s: bad[s] + sum(c["allow"] for *_, c in m) for s, m in under.items()}
        named = defaultdict(list)
        for s, m in under.items():
            own = size[s] >= urls.LEAST_SHARE * sum(size.values()) or apart(lab[s], bad[s], sum(lab.values()), sum(bad.values()))
            named[s if size[s] >= urls.LEAST_PAGES and own else "*"] += m
        for s, m in named.items():
            grow((*made, s), m)

    grow((), [(s, s, c) for s, c in paths.items()])
    return out


def unite(leaves):
    """{template: branch} of one host's {template: (n, b)}, siblings merged from the deepest level."""
    branch = {t: t for t in leaves}

    def total(keep):
        found = [v for t, v in leaves.items() if keep(branch[t])]
        return sum(v[0] for v in found), sum(v[1] for v in found)

    for k in range(max(map(len, leaves)), 0, -1):
        as_any = lambda x: (*x[: k - 1], "/", *x[k:])  # noqa: B023, E731
        now, alike = {x for x in branch.values() if len(x) >= k}, set()
        for own in {x[:k] for x in now}:
            if len({x[:k] for x in now if x[: k - 1] == own[:-1]}) == 1:
                continue
            n, b = total(lambda x: x[:k] == own and len(x) >= k)
            odd = any(apart(*total(lambda y: y == x), *total(lambda y: y in now and as_any(y) == as_any(x))) for x in now if x[:k] == own)
            if n and not odd and not apart(n, b, *total(lambda x: len(x) >= k and x[: k - 1] == own[:-1])):
                alike.add(own)
        branch = {t: as_any(x) if len(x) >= k and x[:k] in alike else x for t, x in branch.items()}
    return branch


def test_templates_and_purities_by_brute_force(spark):
    """Verdicts of a tree that is grown and merged node by node, over random paths of several depths."""
    pick = random.Random(5)
    hosts = ["a.com", "b.com", "example.org", "d.net"]
    rows = []
    for _ in range(1500):
        deep = [pick.choice(["fr", "de", "es", "en"]), *(pick.choice(["a", "b", "c", "7", f"s{pick.randrange(300)}"]) for _ in range(pick.randrange(5)))]
        rows.append(f"http://{pick.choice(hosts)}/{'/'.join(deep)}")
    rules = (*urls.RULES, ("block", "example.org", "/de/"), ("block", "example.org", "/en/a"), ("allow", "d.net", "/es/"), ("block", "d.net", "/fr/b"), ("block", "d.net", "/fr/c"))
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).collect()
    by_host, shape = defaultdict(lambda: defaultdict(Counter)), {}
    for r in got:
        segs = tuple(re.sub("[0-9]+", "{n}", r.path[1:]).split("/"))
        shape[r.page_id] = segs
        by_host[r.host][segs][r.verdict if r.rule else "none"] += 1
    found, every = {}, Counter()
    for host, paths in by_host.items():
        names, leaves = tree(paths), defaultdict(lambda: (0, 0))
        for segs, c in paths.items():
            n, b = leaves[names[segs]]
            leaves[names[segs]] = n + c["allow"] + c["block"], b + c["block"]
        branch, pool = unite(leaves), Counter()
        for t, (n, b) in leaves.items():
            pool[branch[t], "n"] += n
            pool[branch[t], "b"] += b
            every[t, "n"] += n
            every[t, "b"] += b
        found[host] = names, branch, pool
    for r in got:
        names, branch, pool = found[r.host]
        t = names[shape[r.page_id]]
        prior = (every[t, "b"] + urls.PRIOR / 2) / (every[t, "n"] + urls.PRIOR)
        purity = (pool[branch[t], "b"] + urls.PRIOR * prior) / (pool[branch[t], "n"] + urls.PRIOR)
        assert r.template == "/" + "/".join(t)
        assert abs(r.purity - purity) < 1e-9
        assert r.rule or r.verdict == ("block" if purity >= urls.REJECT else "allow")
    assert {r.verdict for r in got if not r.rule} == {"allow", "block"}


def test_deep_and_long_paths(spark):
    """Paths differ at their last of 400 segments, or in a segment of 200,000 letters; none is cut."""
    deep = "/".join(["x"] * 399)
    rows = [f"http://b.net/{deep}/{last}" for last in "aaaabbbb"] + [f"http://c.net/{'y' * 200_000}{last}" for last in "aaaabbbb"]
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    assert {r.template for r in got} == {u.split(".net")[1] for u in rows}


def test_sibling_branches_merge_at_inner_levels(spark):
    """Two sections alike in labels pool; a third, with the same share but other templates blocked, stays apart."""
    rules = (("block", "h.net", "/a/x"), ("allow", "h.net", "/a/y"), ("block", "h.net", "/b/x"), ("allow", "h.net", "/b/y"), ("allow", "h.net", "/c/x"), ("block", "h.net", "/c/y"))
    rows = [f"http://h.net/{s}/{t}/{i}" for s, m in (("a", 60), ("b", 60), ("c", 6)) for t in "xy" for i in range(m)]
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules)
    of = {r.template: r.purity for r in got.collect()}
    assert of["/a/x/{n}"] == of["/b/x/{n}"] > 0.95 and of["/c/x/{n}"] < 0.5 < of["/c/y/{n}"]


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
