"""Mixing sources to target weights, by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents are dealt into shards of bounded size in a seeded order. A shard's words,
end to end, are cut into equal blocks. Sainte-Laguë hands the mix's blocks to sources, a source's
blocks to groups of shards, and a group's to its shards; so each shard knows its integer quota before
any block is picked. A shard then takes whole passes plus a seeded run of blocks.

Native: DataFrame functions only. No row of the plan beyond one per document, shard or source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import WORD, stage

WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the corpus, and most passes over a document.
SHARE, PASSES = 1.5, 2
#: Words of a shard, about; one shard is the unit that a task orders.
SHARD_TOKENS = 1 << 16
#: Words of a block at most. A block is a 2**20th of the mix, so small corpora are cut as finely as large ones.
BLOCK_TOKENS, BLOCKS = 64, 1 << 20


def apportion(df: DataFrame, parent: list[str], key: str, weight: str, seats: str, out: str) -> DataFrame:
    """df with `out`: the rows of one parent share its `seats` by Sainte-Laguë on `weight`.

    The divisor lies between W / (n + m/2) and W / (n - m/2) for m rows of total weight W and n seats.
    Rounding by the larger gives seats that a row has for certain, by the smaller the most it can have;
    only the few seats between are ranked by quotient, at most 2 m of them. Ties go to the smaller key.
    """
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    total, many = F.sum(weight).over(by), F.count("*").over(by)
    sure = F.when(F.col(seats) > F.col("_m") / 2, F.floor(F.col(weight) * (F.col(seats) - F.col("_m") / 2) / F.col("_w") + 0.5)).otherwise(0)
    most = F.ceil(F.col(weight) * (F.col(seats) + F.col("_m") / 2) / F.col("_w") + 0.5)
    df = df.withColumn("_w", total).withColumn("_m", many)
    df = df.withColumn("_sure", F.when(F.col("_w") > 0, F.greatest(F.lit(0), sure - 1)).otherwise(0).cast("long")).withColumn("_most", F.when(F.col("_w") > 0, most).otherwise(0).cast("long"))
    df = df.withColumn("_open", F.col(seats) - F.sum("_sure").over(by))
    each = df.select("*", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence("_sure", F.col("_most") - 1))).alias("_k"))
    quotient = F.when(F.col("_k").isNotNull(), F.col(weight) / (2 * F.col("_k") + 1))
    rank = F.row_number().over(by.orderBy(quotient.desc_nulls_last(), F.col(key)))
    each = each.withColumn("_won", ((F.col("_k").isNotNull()) & (rank <= F.col("_open"))).cast("long"))
    return each.groupBy(*df.columns).agg(F.sum("_won").alias("_more")).withColumn(out, F.col("_sure") + F.col("_more")).drop("_w", "_m", "_sure", "_most", "_open", "_more")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """source, source_size, target of every source; sizes has source and size.

    Targets fill like water: by weight up to `passes` times the source's size, the excess reshared.
    Sources in order of cap / weight stop at their cap as long as the level of the rest is above it.
    One row a source passes through one task: a catalogue, not the corpus.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    per = per.withColumn("_rank", order.cast("long")).withColumn("weight", weight).withColumn("_cap", passes * F.col("source_size").cast("double"))
    fill = W.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    budget = share * F.sum("source_size").over(W.partitionBy()).cast("double")
    left = budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("_level", left / rest)
    per = per.withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("weight"))
    level = F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(W.partitionBy())
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * level))
    return per.withColumn("target", target).select("source", "source_size", "weight", "target", "_rank")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = 42, shard_tokens: int = SHARD_TOKENS, block_tokens: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, block_tokens for each row of docs (doc_id, text, source).

    A null text has size 0; a null source is a source of its own, the last; an empty table gives no
    rows. Repeated rows are rows of their own. Rows alike in id and size are ordered arbitrarily among
    themselves, which changes no count. Other columns are not looked at. `taken` never exceeds `passes`
    times the size. The same rows give the same mix, however they are partitioned.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return mix_sizes(stage(docs.select("doc_id", "source", size.alias("size"))), weights, share, passes, seed, shard_tokens, block_tokens)


def mix_sizes(sizes: DataFrame, weights: tuple, share: float, passes: int, seed: int, shard_tokens: int, block_tokens: int | None) -> DataFrame:
    """The mix from a stored table of doc_id, source, size."""
    plan = source_targets(sizes, weights, share, passes)
    everything = W.partitionBy(F.lit(0))
    fine = F.lit(block_tokens) if block_tokens else F.greatest(F.lit(1), F.least(F.lit(BLOCK_TOKENS), F.floor(F.sum("target").over(everything) / BLOCKS)))
    plan = plan.withColumn("block_tokens", fine.cast("long")).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long"))
    plan = plan.withColumn("groups", F.ceil(F.sqrt("shards")).cast("long")).withColumn("seats", F.round(F.sum("target").over(everything) / F.col("block_tokens")).cast("long"))
    plan = stage(apportion(plan, [], "_rank", "target", "seats", "source_seats"), 1)
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    # The plan has a row a source: Spark sends it to all tasks while its file is small, and deals out both sides, splitting hot sources, beyond.
    every = sizes.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    dealt = every.where("size > 0").withColumn("_order", order).withColumn("shard", F.pmod(order, F.col("shards")))
    shards = dealt.groupBy("_rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("groups").alias("groups"), F.first("source_seats").alias("source_seats"), F.first("block_tokens").alias("block_tokens"))
    shards = shards.withColumn("group", F.col("shard") % F.col("groups"))
    groups = shards.groupBy("_rank", "group").agg(F.sum("shard_size").alias("group_size"), F.first("source_seats").alias("source_seats"))
    groups = apportion(groups, ["_rank"], "group", "group_size", "source_seats", "group_seats").select("_rank", "group", "group_seats")
    quotas = apportion(shards.join(groups, ["_rank", "group"]), ["_rank", "group"], "shard", "shard_size", "group_seats", "quota")
    quotas = stage(quotas.select("_rank", "shard", "shard_size", "quota"), 8)
    rows = W.partitionBy("_rank", "shard").orderBy("_order", "doc_id", "size")
    rows = dealt.join(quotas, ["_rank", "shard"]).withColumn("_end", F.sum("size").over(rows.rowsBetween(W.unboundedPreceding, 0)))
    out = ["doc_id", "source", "size", "source_size", "target", "taken", "block_tokens"]
    empty = every.where("size = 0").withColumn("taken", F.lit(0).cast("long"))  # in no shard: a shard has a word a row at least
    return rows.withColumn("taken", taken(passes, seed)).select(*out).unionByName(empty.select(*out))


def taken(passes: int, seed: int) -> Column:
    """Words that a shard's quota takes from the document that ends at word `_end` of the shard."""
    block, end, start, total = F.col("block_tokens"), F.col("_end"), F.col("_end") - F.col("size"), F.col("shard_size")
    blocks = F.ceil(total / block).cast("long")
    quota = F.least(F.col("quota"), passes * blocks)
    whole, extra = F.floor(quota / blocks).cast("long"), quota % blocks
    first = F.pmod(F.xxhash64(F.col("_rank"), F.col("shard"), F.lit(seed)), blocks)
    shared = lambda a, b: F.greatest(F.lit(0), F.least(end, F.least(b, total)) - F.greatest(start, a))
    run = shared(first * block, (first + extra) * block) + shared(F.lit(0), (first + extra - blocks) * block)
    return F.when(F.col("size") == 0, 0).otherwise(F.least(whole * F.col("size") + run, passes * F.col("size"))).cast("long")
