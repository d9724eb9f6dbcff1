"""Sharding: minimax contiguous partition of atomic groups.

Documents with equal texts form one group, which is never parted. Groups stand in
the order of their text's digest. The smallest capacity for which the groups, taken
in order, fit into the given number of shards is found by binary search with a
greedy check; cuts are made under that capacity.

The order is the order of hex digests, so the digests' prefixes form a tree. Only
sums per prefix come to the driver: first of a few thousand prefixes, then of the
children of those prefixes inside which a cut can still fall. With the sums known so
far two capacities are computed: one if unknown prefixes can't be parted (an upper
bound) and one if they can be parted anywhere (a lower bound). When no unknown
prefix lies where a cut can fall, both agree and the capacity is exact.

Defined results: a null text counts as an empty one (8 bytes, CRC 0) and is in the
group of empty texts; a null ``doc_id`` is a document like others; repeated rows
are one group and get a slot each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import fine_bucket, running_start, stored, whole_text

SHARDS = 24
ROW_BYTES = 8
#: Hex digits of the first level of prefixes; 16 to this power sums come to the driver.
FIRST_DIGITS = 3


class Items:
    """Consecutive pieces of the order: prefix, bytes, and whether a piece is a single group."""

    def __init__(self, rows: list[tuple[str, int, bool]]):
        self.rows = sorted(rows)
        self.ends = list(accumulate(size for _, size, _ in self.rows))
        self.total = self.ends[-1] if self.ends else 0

    def reach(self, start: float, capacity: int, partible: bool) -> int:
        """Where a shard that begins at ``start`` ends at the latest."""
        limit = start + capacity
        if limit >= self.total:
            return self.total
        at = bisect_right(self.ends, limit)
        below = self.ends[at - 1] if at else 0
        if partible and not self.rows[at][2]:
            return limit
        return max(below, start)

    def ends_at(self, capacity: int, shards: int, partible: bool) -> list[int]:
        places, at = [], 0
        for _ in range(shards):
            at = self.reach(at, capacity, partible)
            places.append(at)
        return places

    def smallest(self, shards: int, partible: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.ends_at(middle, shards, partible)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def open_pieces(self, low: int, high: int, shards: int) -> list[str]:
        """Prefixes of several groups inside which a cut may fall for a capacity in [low, high]."""
        first, last = self.ends_at(low, shards, False), self.ends_at(high, shards, True)
        found = set()
        for begin, end in zip(first, last, strict=True):
            # pieces that have a point strictly inside [begin, end], or hold it
            at = bisect_right(self.ends, begin)
            while at < len(self.rows):
                piece_start = self.ends[at] - self.rows[at][1]
                if piece_start >= end and not piece_start < begin:
                    break
                if not self.rows[at][2]:
                    found.add(self.rows[at][0])
                at += 1
        return sorted(found)


def sums(groups: DataFrame, digits: int) -> list[tuple[str, int, bool]]:
    rows = groups.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    return [(r["p"], r["b"], r["n"] == 1) for r in rows]


def resolve(groups: DataFrame, shards: int, first_digits: int = FIRST_DIGITS) -> tuple[Items, int]:
    """The pieces that matter, and the smallest capacity that holds."""
    digits = first_digits
    items = Items(sums(groups, digits))
    while True:
        high, low = items.smallest(shards, False), items.smallest(shards, True)
        unknown = [p for p in items.open_pieces(low, high, shards) if len(p) == digits]
        if not unknown:
            return items, high
        inside = F.substring("key", 1, digits).isin(unknown)  # some hundred prefixes around the cuts
        digits += 1
        parted = set(unknown)
        items = Items([r for r in items.rows if r[0] not in parted] + sums(groups.filter(inside), digits))


def cut_keys(items: Items, capacity: int, shards: int) -> list[str]:
    """First prefix of each shard after the first.

    Any cut between the latest one (greedy from the front) and the earliest one
    (greedy from the end) keeps all shards within the capacity; the one nearest to
    an even share of what is left is taken, so that one large group does not empty
    the shards after it.
    """
    bounds = [0, *items.ends]
    earliest = [items.total] * (shards + 1)
    for j in range(shards - 1, -1, -1):
        earliest[j] = bounds[bisect_left(bounds, earliest[j + 1] - capacity)]
    keys, at = [], 0
    for j in range(1, shards):
        ideal = at + (items.total - at) / (shards - j + 1)
        near = min(bisect_left(bounds, ideal), len(bounds) - 1)
        if near and ideal - bounds[near - 1] <= bounds[near] - ideal:
            near -= 1
        # no shard stays empty while there are pieces: one for this shard, and one for each behind it
        least = max(bisect_left(bounds, earliest[j]), bisect_right(bounds, at))
        near = max(min(near, len(bounds) - 1 - (shards - j)), least)
        near = min(near, bisect_right(bounds, at + capacity) - 1)
        at = bounds[near]
        keys.append(items.rows[near][0] if near < len(items.rows) else "~")
    return keys


def shard_documents(docs: DataFrame, shards: int = SHARDS, first_digits: int = FIRST_DIGITS) -> DataFrame:
    """A shard and a place in it for each document; equal texts share a shard."""
    text = whole_text()
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("key"),
        ),
        "shard-rows",
    )
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    items, capacity = resolve(groups, shards, first_digits)
    shard = F.lit(0)
    for key in cut_keys(items, capacity, shards):
        shard = shard + (F.col("key") >= F.lit(key)).cast("int")
    buckets = max(1, int((rows.count() / shards) ** 0.5))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("_order", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("key"))))
    placed = placed.withColumn("_bucket", fine_bucket(F.col("_order"), F.lit(buckets)))
    placed = running_start(placed, "shard", "_bucket", ["_order", "size"], F.lit(1), "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
