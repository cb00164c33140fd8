"""URL filters: listed rules, and a path-template tree for what no rule fits.

Each host has a tree of path segments, as deep as its paths. It grows from the top: segments that vary
become wildcards. Then sibling branches merge from the bottom, at every level where the tree branches, if
neither their labelled shares of blocked pages nor those of the same templates below them differ
significantly. A template is rejected when the purity of its merged branch, smoothed by the same template
on all hosts, reaches a bound. The pages that rules judge are the labelled ones. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A segment stays literal with so many pages, if they are such a share of its parent's or if its labels differ from its siblings'.
LEAST_PAGES, LEAST_SHARE = 3, 0.02
#: What a segment that varies is called; the name of branches that merged, which no segment can have.
ANY, ALIKE = "*", "/"
#: Standard errors from which a branch differs from its siblings; pages that the prior is worth; purity from which a template is rejected.
DIFFERS, PRIOR, REJECT = 2.0, 4.0, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None)
    for verdict, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """The path's segments, each run of digits as {n}."""
    return F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "{n}"), "/")


def differs(n: Column, b: Column, all_n: Column, all_b: Column) -> Column:
    """Whether b of n labelled pages depart from all_b of all_n by over DIFFERS standard errors; false if n is 0."""
    p = F.try_divide(all_b, all_n)
    return F.coalesce(F.abs(F.try_divide(b, n) - p) > DIFFERS * F.sqrt(F.try_divide(p * (1 - p), n)), F.lit(False))


def sums(df: DataFrame, *keys: str, **names: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in names.items()])


def templates(shapes: DataFrame) -> tuple[DataFrame, list[int]]:
    """shapes (host, segments, pages, labelled, blocked) with `template`, an array; the levels where the tree branches.

    A round takes every node past the segments that all its paths share, and then one level down. Nodes of too
    few pages for a literal segment, and those with one path left, end at once, so rounds are as many as the
    branchings on one path.
    """
    own, node = ["host", "segments", "pages", "labelled", "blocked"], ["host", "made"]
    live = shapes.select(*own, F.array().cast("array<string>").alias("made"), F.col("segments").alias("rest"))
    done, levels = [], set()
    while not live.isEmpty():
        ends = live.groupBy(*node).agg(F.sum("pages").alias("all_pages"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        parts = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), False)  # what lies between shares what both share
        few = F.col("all_pages") < LEAST_PAGES
        shared = F.when(parts == 0, F.size("rest")).otherwise(parts - 1).cast("int")
        found = live.join(ends.select(*node, few.alias("few"), parts.alias("parts"), "all_pages", "low", "high"), node).withColumn("shared", shared)
        made = F.concat("made", F.when(F.col("few"), F.array_repeat(F.lit(ANY), F.size("rest"))).otherwise(F.slice("rest", F.lit(1), F.col("shared"))))
        after = F.slice("rest", F.col("shared") + 2, F.size("rest"))
        step = stage(found.select(*own, made.alias("made"), F.get("rest", F.col("shared")).alias("segment"), after.alias("rest"), (F.col("few") | (F.size("rest") == F.col("shared"))).alias("ends")))
        done.append(step.where("ends").select(*own, F.col("made").alias("template")))
        onward = step.where("not ends")
        counts = sums(onward, *node, "segment", n="pages", l="labelled", b="blocked")
        totals = sums(counts, *node, total="n", all_l="l", all_b="b")
        literal = (F.col("n") >= LEAST_PAGES) & ((F.col("n") >= LEAST_SHARE * F.col("total")) | differs(F.col("l"), F.col("b"), F.col("all_l"), F.col("all_b")))
        names = counts.join(totals, node).select(*node, "segment", F.when(literal, F.col("segment")).otherwise(ANY).alias("name"))
        live = stage(onward.join(names, [*node, "segment"]).select(*own, F.concat("made", F.array("name")).alias("made"), "rest"))
        levels |= {r[0] for r in live.select(F.size("made")).distinct().collect()}
    every = shapes.select(*own, F.array().cast("array<string>").alias("template")).where(F.lit(False))
    for d in done:
        every = every.union(d)
    return every, sorted(levels)


def merged(leaves: DataFrame, levels: list[int]) -> DataFrame:
    """leaves (host, template, n, b) with `branch`, the template with the segments of merged branches as ALIKE.

    From the deepest level, a branch merges with its siblings, if there are any, if it has labelled pages and neither its own share of
    blocked ones nor that of any template below differs from what all siblings have; what differs stays apart.
    """
    leaves = leaves.withColumn("branch", F.col("template"))
    for k in reversed(levels):
        size, above = F.size("branch"), F.slice("branch", 1, k - 1)
        general = F.concat(above, F.array(F.lit(ALIKE)), F.slice("branch", F.lit(k + 1), size))
        deep = leaves.where(size >= k).select("host", above.alias("above"), F.slice("branch", 1, k).alias("own"), general.alias("general"), "n", "b")
        units = stage(sums(deep, "host", "above", "own", "general", n="n", b="b"))
        test = differs(F.col("n"), F.col("b"), F.col("all_n"), F.col("all_b"))
        odd = units.join(sums(units, "host", "general", all_n="n", all_b="b"), ["host", "general"]).where(test).select("host", "own")
        siblings = units.groupBy("host", "above").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high")
        whole = sums(units, "host", "above", "own", n="n", b="b").where("n > 0").join(siblings, ["host", "above"])
        alike = whole.where(~test).select("host", "own").join(odd, ["host", "own"], "left_anti").withColumn("alike", F.lit(True))
        leaves = leaves.withColumn("own", F.slice("branch", 1, k)).join(alike, ["host", "own"], "left")
        leaves = stage(leaves.select("host", "template", "n", "b", F.when(F.col("alike") & (size >= k), general).otherwise(F.col("branch")).alias("branch")))
    return leaves


def purities(found: DataFrame, levels: list[int]) -> DataFrame:
    """host, template, purity: the smoothed share of blocked pages among the labelled ones of a template's branch."""
    leaves = merged(stage(sums(found, "host", "template", n="labelled", b="blocked")), levels)
    pooled = sums(leaves, "host", "branch", branch_n="n", branch_b="b")
    everywhere = sums(leaves, "template", every_n="n", every_b="b")
    leaves = leaves.join(pooled, ["host", "branch"]).join(everywhere, "template")
    prior = (F.col("every_b") + PRIOR * 0.5) / (F.col("every_n") + PRIOR)
    return leaves.select("host", "template", ((F.col("branch_b") + PRIOR * prior) / (F.col("branch_n") + PRIOR)).alias("purity"))


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each row of pages (page_id, url).

    The longest fitting rule decides; else the template does: block from purity REJECT on. A null url,
    or one without ://, has empty host and path and is a template of its own. Rows that repeat count
    and are judged each; a null page_id stays. No rows give no rows; other columns are not looked at.
    Paths of any length are taken whole; a segment that is itself * counts as one that varies.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segments", segments(F.col("path")))
    labelled = F.col("found").isNotNull().cast("long")
    blocked = F.coalesce(F.col("found.verdict") == "block", F.lit(False)).cast("long")
    shapes = rows.groupBy("host", "segments").agg(F.count("*").alias("pages"), F.sum(labelled).alias("labelled"), F.sum(blocked).alias("blocked"))
    found, levels = templates(stage(shapes))
    found = stage(found)
    pure = purities(found, levels)
    name = F.concat(F.lit("/"), F.array_join("template", "/")).alias("template")
    shapes = stage(found.join(pure, ["host", "template"]).select("host", "segments", name, "purity"))
    rows = rows.join(shapes, ["host", "segments"])
    verdict = F.coalesce("found.verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
