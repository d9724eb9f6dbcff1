"""Small corpora with awkward rows, and plain versions of what the operators compute."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; documents may bring columns of these names.
CLASHING = ["size", "key", "shard", "slot", "node", "root", "kept", "taken", "target", "blocks", "bands", "line", "start", "_row", "rank"]


def prose(seed: int, n: int, vocabulary: int = 4000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", "."]) for _ in range(n)]


def text(seed: int, n: int) -> str:
    words = prose(seed, n)
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def changed(words: str, seed: int, n: int) -> str:
    """The text with n words replaced."""
    rng, parts = random.Random(seed), words.split(" ")
    for _ in range(n):
        parts[rng.randrange(len(parts))] = f"x{rng.randrange(10**6)}"
    return " ".join(parts)


AWKWARD = [
    (900, None, "en", "a", 0), (901, "", "en", "a", 0), (902, " \t\n\r\x0b\x0c ", "en", None, 7), (903, "one two", None, "b", None),
    (None, text(77, 40), "en", "b", 1), (None, None, None, None, None), (904, "tie " * 30, "en", "c", 1),
    (905, text(78, 30), "en", "c", 1), (905, text(78, 30), "en", "c", 1), (906, "über straße   naïve퟿ 😀 " * 3, "de", "c", 1),
]


def rows() -> list[tuple]:
    found: list[tuple] = [(i, text(i, 30 + 7 * (i % 9)), "en", "abc"[i % 3], 1) for i in range(24)]
    found += [(100 + i, text(3, 51), "en", "a", 1) for i in range(5)]  # copies
    found += [(200 + i, changed(text(500, 140), i, 2), "en", "d", 1) for i in range(4)]  # near copies
    passage = " ".join(prose(600, 60))
    found += [(300 + i, f"{text(700 + i, 50)} {passage} {text(800 + i, 50)}", "en", "e", 1) for i in range(3)]
    found += [(400, " ".join(prose(9, 20) * 4), "en", "e", 1), (401, text(401, 3000), "en", None, 1)]
    return found + AWKWARD


def frame(spark: SparkSession, data: list[tuple], clashing: bool = True) -> DataFrame:
    docs = spark.createDataFrame(data, SCHEMA)
    return docs.withColumns({name: F.lit(f"own {name}") for name in CLASHING}) if clashing else docs


def words(t: str | None) -> list[str]:
    return WORD.findall(t or "")


def shingles(t: str | None, width: int = 5) -> frozenset:
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def linked(data: list[tuple]) -> list[int]:
    """Number of the component of each row: all pairs, then union by repetition."""
    sets, group = [shingles(r[1]) for r in data], list(range(len(data)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def repeated_words(w: list[str], width: int = 5) -> int:
    count = Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return len({k for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for k in range(i, i + width)})


def mix(data: list[tuple], block_words: int = 64) -> tuple[dict, list[int]]:
    """Targets by repeated resharing, seats one by one, words taken row by row."""
    sizes = [len(words(r[1])) for r in data]
    by_source: dict = defaultdict(int)
    for r, n in zip(data, sizes, strict=True):
        by_source[r[3]] += n
    order = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes), {}, list(order)
    while free:
        left = total - sum(target.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * by_source[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 3.0 * by_source[s] for s in over}
        free = [s for s in free if s not in over]
    size = max(1, min(block_words, total // 10_000))
    seats = dict.fromkeys(order, 0)
    heap = [(-target[s], i) for i, s in enumerate(order) if target[s] > 0]
    heapq.heapify(heap)
    for _ in range(round(total / size) if heap else 0):
        _, i = heapq.heappop(heap)
        seats[order[i]] += 1
        heapq.heappush(heap, (-target[order[i]] / (2 * seats[order[i]] + 1), i))
    taken, start = [0] * len(data), dict.fromkeys(order, 0)

    def place(i: int) -> tuple:
        seeded = "mix-1" + (f":{data[i][0]}" if data[i][0] is not None else "")
        return hashlib.md5(seeded.encode()).hexdigest(), sizes[i]

    for i in sorted(range(len(data)), key=place):
        s = data[i][3]
        if by_source[s]:
            passes, rest = divmod(min(seats[s] * size, 3 * by_source[s]), by_source[s])
            taken[i] = passes * sizes[i] + max(0, min(sizes[i], rest - start[s]))
        start[s] += sizes[i]
    return target, taken


def capacity(sizes: list[int], shards: int) -> int:
    """Smallest largest shard over all contiguous partitions, by trying capacities."""
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        middle, used, load = (low + high) // 2, 1, 0
        for s in sizes:
            used, load = (used + 1, s) if load + s > middle else (used, load + s)
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low
