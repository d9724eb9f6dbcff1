"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-word blocks.

Sources share the corpus size by weight; a share stops at three times its source's
size and the excess goes to the others by weight. The mix is a row of blocks of
equal word count, filled shard by shard: block seats go to the source with the
highest quotient target / (2 * seats so far + 1). Seats are awarded in one order for
the whole mix, so that the quota of a source in a shard is the difference of two
apportionments and never negative.

A source's words lie in a seeded order of its documents. Its seats take blocks of
that line one after another, from its start again when it is used up; so a document
is taken as often as blocks pass over its words, in part at the ends.

Nothing is awarded seat by seat: all seats but about one per source follow from two
divisors which enclose the right one, and only the quotients between are ranked.

Defined results: a null text has size 0; a null source is a source of its own, the
last; a null ``doc_id`` is a document like others; repeated rows count each; rows
equal in id and size are interchangeable; an empty table gives no rows; a corpus
without words takes nothing; other columns are ignored. The table of sources (not
of documents) stands in one window, so sources must number in the thousands at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import WORD, fine_bucket, running_start, stored, whole_text

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 64
SHARD_BLOCKS = 65_536
SEED = "mix-1"


def sized_columns(seed: str) -> list[Column]:
    """Id, source, words and seeded order of a document."""
    return [
        F.col("doc_id"), F.col("source"), F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("order_key"),
    ]


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select(*sized_columns(seed))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row per source: rank, size, weight, and its target under the limit on repeats.

    Sorted by the level at which they reach their limit, the sources below the
    final level are full; the first one that the level of the rest does not fill
    gives the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_limit = Window.orderBy("_full_at", "source_rank")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    sources = sources.withColumn("source_rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") - 1) % len(weights) + 1)
    sources = (
        sources.withColumn("weight", weight.cast("double"))
        .withColumn("_limit", max_repeats * F.col("source_size"))
        .withColumn("_full_at", F.col("_limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
    )
    filled = F.coalesce(F.sum("_limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("_level", (F.col("total") - filled) / rest)
    level = F.min_by(F.when(F.col("_level") <= F.col("_full_at"), F.col("_level")), F.when(F.col("_level") <= F.col("_full_at"), F.struct("_full_at", "source_rank"))).over(everything)
    return sources.withColumn("target", F.least(F.col("_limit").cast("double"), level * F.col("weight"))).select(
        "source", "source_rank", "documents", "source_size", "weight", "total", "target",
    )


def with_block(sources: DataFrame, block_words: int) -> DataFrame:
    """The words of a block: the given number, less in a corpus of under ten thousand such blocks."""
    return sources.withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("total") / 10_000))).cast("long"))


def shard_quotas(sources: DataFrame, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """Blocks that each source gives to each shard, with the number of its first one."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    in_shard = Window.partitionBy("shard")
    alive = F.sum((F.col("target") > 0).cast("int")).over(everything)
    cells = (
        sources.withColumn("_alive", alive).filter("target > 0")
        .withColumn("_blocks", F.round(F.col("total") / F.col("block_words")).cast("long"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_blocks") - 1) / shard_blocks))))
        .withColumn("_seats", F.least((F.col("shard") + 1) * shard_blocks, F.col("_blocks")))
    )
    share = F.col("target") / F.col("total")
    cells = (
        cells.withColumn("_sure", F.greatest(F.lit(0), F.floor(share * (F.col("_seats") - F.col("_alive") / 2) + 0.5)).cast("long"))
        .withColumn("_most", F.greatest(F.col("_sure"), F.floor(share * (F.col("_seats") + F.col("_alive") / 2) + 0.5)).cast("long"))
        .withColumn("_open", F.col("_seats") - F.sum("_sure").over(in_shard))
    )
    seats = cells.withColumn("_seat", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_most") - 1))))
    quotient = F.col("target") / (2 * F.col("_seat") + 1)
    best = in_shard.orderBy(F.desc_nulls_last("_quotient"), "source_rank", "_seat")
    awarded = (
        seats.withColumn("_quotient", quotient).withColumn("_place", F.row_number().over(best))
        .groupBy("source_rank", "shard").agg((F.max("_sure") + F.sum((F.col("_seat").isNotNull() & (F.col("_place") <= F.col("_open"))).cast("long"))).alias("_until"))
    )
    earlier = F.coalesce(F.lag("_until").over(Window.partitionBy("source_rank").orderBy("shard")), F.lit(0))
    return awarded.select("source_rank", "shard", (F.col("_until") - earlier).alias("quota"), earlier.alias("first_block"))


def mix_plan(rows: DataFrame, weights: tuple[int, ...], max_repeats: int, block_words: int, shard_blocks: int) -> DataFrame:
    """Per source: its target, the blocks of all shards together, and the words that they take."""
    sources = with_block(source_targets(rows, weights, max_repeats), block_words)
    blocks = shard_quotas(sources, shard_blocks).groupBy("source_rank").agg(F.sum("quota").alias("source_blocks"))
    return stored(
        sources.join(blocks, "source_rank", "left").withColumn("source_blocks", F.coalesce("source_blocks", F.lit(0).cast("long")))
        .withColumn("source_taken", F.least(F.col("source_blocks") * F.col("block_words"), max_repeats * F.col("source_size")))
        .withColumn("_buckets", F.greatest(F.lit(1), F.floor(F.sqrt("documents")))).withColumnRenamed("source", "_source"),
        "mix-plan",
    )


def taken_words(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the words that the mix takes of each row."""
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.withColumn("_bucket", fine_bucket(F.col("order_key"), F.col("_buckets")))
    placed = running_start(placed, "source_rank", "_bucket", ["order_key", "size"], F.col("size"), "_start")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("source_taken") / F.col("source_size"))).otherwise(0)
    left = F.col("source_taken") - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_start")))
    return placed.withColumn("taken", taken.cast("long"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: str = SEED,
) -> DataFrame:
    """How many words of each document the mix takes, repeats counted."""
    rows = stored(sized(docs, seed), "mix-rows")
    plan = mix_plan(rows, weights, max_repeats, block_words, shard_blocks)
    return taken_words(rows, plan).select("doc_id", "size", "source_size", "target", "taken", "source_blocks", "block_words")


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: str = SEED,
) -> DataFrame:
    """The documents of the mix, each as many times as it is taken, rounded to whole texts."""
    plan = mix_plan(stored(sized(docs, seed), "mix-rows"), weights, max_repeats, block_words, shard_blocks)
    rows = docs.select(F.struct("*").alias("_row"), *sized_columns(seed))
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = taken_words(rows, plan).filter("size > 0").select(F.explode(F.array_repeat("_row", copies)).alias("_row"))
    return taken.select("_row.*")
