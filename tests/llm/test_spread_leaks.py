"""Leaks whose words retrieval passes over: spread thin, or frequent."""

from __future__ import annotations

import numpy as np

from riskweave.llm import decontamination
from tests.llm import corpora

ITEM = [f"term{i}" for i in range(40)]
#: In every document: no passage stands out by these.
COMMON = [f"often{i}" for i in range(30)]
LONG = [f"long{i}" for i in range(60)]


def spread(words: list[str], gap: int, name: str) -> str:
    """The words with ``gap`` others behind each."""
    return " ".join(w + "".join(f" {name}{i}x{j}" for j in range(gap)) for i, w in enumerate(words))


def table(spark):
    kept = [w for i, w in enumerate(ITEM) if i % 5]  # 32 of 40
    texts = {
        1: spread(kept, 4, "a"),
        2: spread(kept[1:], 4, "b"),  # 31 of 40 and no answer in one piece
        3: spread(ITEM[:17], 6, "c") + " " + " ".join(ITEM[-5:]),  # 22 of 40 and the answer
        4: spread(ITEM[:16], 6, "d") + " " + " ".join(ITEM[-5:]),
        5: " ".join(COMMON),
        6: " ".join(reversed(COMMON)),
        7: "",
        8: None,
    }
    texts |= {100 + i: " ".join(np.random.default_rng(i).permutation(COMMON)) + f" own{i}" for i in range(40)}
    return corpora.frame(spark, [(k, t, "en", "a", 1) for k, t in texts.items()])


def test_spread_and_frequent_items_are_found(spark):
    items = [(0, " ".join(ITEM)), (1, " ".join(COMMON)), (2, " ".join(LONG))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["lcs_words"] for r in decontamination.leaks(table(spark), benchmark).collect()}
    assert got == {(1, 0): 32, (3, 0): 22, (5, 1): 30}


def test_every_possible_pair_is_kept():
    """All pairs that the words' order confirms are among the possible ones."""
    rng = np.random.default_rng(7)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, size))) for i, size in enumerate((8, 12, 20, 33))]
    block = decontamination.Block(items)
    bounds = decontamination.WordBounds(block, rng.random(len(block.terms)))
    around = block.longest + block.longest // 4
    texts = [[f"w{x}" for x in rng.integers(0, 60, size)] for size in (0, 3, 30, 200, 700, 900)]
    for i, (_, text) in enumerate(items):
        words = text.split()
        texts.append(texts[3][:50] + [x for w in words[i % 3 :] for x in (w, "other")] + texts[3][50:])
    sizes = np.array([len(t) for t in texts])
    terms = block.numbered([w.encode() for t in texts for w in t])
    first = decontamination.cut(sizes)[0]
    found = bounds.possible_pairs(sizes, terms, first, around)
    starts, confirmed = np.cumsum(sizes) - sizes, 0
    for d, size in enumerate(sizes.tolist()):
        for n in range(int(first[d + 1] - first[d])):
            begin = n * decontamination.HALF
            region = terms[starts[d] + max(0, begin - around) : starts[d] + min(size, begin + 2 * decontamination.HALF + around)]
            for i, item in enumerate(block.words):
                common = decontamination.lcs(item, region)
                answered = decontamination.holds(region, item[-decontamination.ANSWER_WORDS :])
                if 100 * common >= 80 * len(item) or (answered and 100 * common >= 55 * len(item)):
                    assert i in found[int(first[d]) + n]
                    confirmed += 1
    assert confirmed > 10
