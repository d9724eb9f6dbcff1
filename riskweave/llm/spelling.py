"""Grouping of spelling variants by composing finite-state machines.

The vocabulary's minimised acceptor is composed with a transducer that makes exactly one
edit and with the acceptor again; what the composition accepts are the pairs of words one
inserted, deleted or replaced code point apart.

A composition is enumerated per initial state, so the vocabulary is never in one place. Two
words that are one edit apart, the shorter of length m, agree in their first m // 2 code
points or in their last m - m // 2. So a word's initial states are those that reading
these halves leads to, in the acceptor and in the one of reversed reading, for m its own
length and one less: four rows per word. A task builds one minimised acceptor for many
initial states; equal tails are one state, whose edits are worked out once. The edit falls
behind the half that was read. An initial state with more than ``BLOCK`` words is cut into
parts, and the acceptors of all pairs of parts are composed.

Words are counted per batch before they are shuffled; forms are followed to their roots by
joining the table of forms with itself, each time over twice the distance.

Defined results: a null or empty text has no words; a document without id counts its words
under an empty id; equal rows count each; an empty table gives no rows; other columns
are ignored. A form occurs at least twice as often as its word, so following forms ends.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import stored, texts_of
from riskweave.llm.grouped import together, whole_groups

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT = 5, 3
#: One in so many (document, word) pairs loses a code point, by the crc32 of both.
DAMAGED_ONE_IN = 97
#: A form occurs at least so many times as often as the word.
FORM_RATIO = 2
#: Most words of an initial state that are put into one acceptor.
BLOCK = 20_000
#: Words of many initial states that share an acceptor.
RUN_WORDS = 40_000
#: Words of more code points are compared one by one inside an initial state; they share a hundred at least there.
LONG = 200
#: Distinct words that a task holds while it counts.
HELD_WORDS = 400_000

Arcs = list[tuple[str, int]]


def observed(doc_id: int | None, text: bytes, one_in: int = DAMAGED_ONE_IN) -> Counter:
    """Words of a document, each as often as it stands there."""
    own = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    own = zlib.crc32(b":", own)
    found: Counter = Counter()
    for word, n in Counter(RUN.findall(text.lower().decode(errors="replace"))).items():  # bytes.lower() changes A-Z only
        h = zlib.crc32(word.encode(), own)
        if h % one_in == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        found[word] += n
    return found


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""

    def emitted(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), texts_of(batch), strict=True):
                for word, n in observed(doc_id, text).items():
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield emitted(held)
                    held = Counter()
        yield emitted(held)

    counts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def one_edit(x: str, y: str) -> bool:
    """Are the words exactly one edit apart?"""
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if len(long) - len(short) > 1 or short == long:
        return False
    same = len(os.path.commonprefix([short, long]))
    return short[same + (len(long) == len(short)) :] == long[same + 1 :]


class Acceptor:
    """Minimised acyclic acceptors that share their states, and their composition over one edit."""

    def __init__(self) -> None:
        self.register: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.arcs: list[Arcs] = []
        self.common: dict[tuple[int, int], list[str]] = {}
        self.edits: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def state(self, final: bool, arcs: Arcs) -> int:
        """The state with this future; equal futures are one state."""
        key = (final, *arcs)
        found = self.register.get(key)
        if found is None:
            found = self.register[key] = len(self.final)
            self.final.append(final)
            self.arcs.append(arcs)
        return found

    def initial(self, words: list[str]) -> int:
        """The initial state of an acceptor of these distinct words, in ascending order."""
        path: list[tuple[list[bool], Arcs]] = [([False], [])]
        last = ""
        for word in [*words, None]:
            same = 0
            if word is not None:
                most = min(len(word), len(last))
                while same < most and word[same] == last[same]:
                    same += 1
            while len(path) > same + 1:
                ended, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], self.state(ended[0], arcs)))
            if word is not None:
                path += [([False], []) for _ in word[same:]]
                path[-1][0][0] = True
                last = word
        return self.state(path[0][0][0], path[0][1])

    def both(self, s: int, t: int) -> list[str]:
        """What is accepted from both states."""
        key = (s, t) if s <= t else (t, s)
        found = self.common.get(key)
        if found is None:
            found = [""] if self.final[s] and self.final[t] else []
            other = dict(self.arcs[t])
            for c, a in self.arcs[s]:
                b = other.get(c)
                if b is not None:
                    found += [c + rest for rest in self.both(a, b)]
            self.common[key] = found
        return found

    def edited(self, s: int, t: int) -> list[tuple[str, str]]:
        """Pairs accepted from s and t whose edit is the next step.

        A code point inserted into a run of its like counts as the run's last, so each pair has one place.
        """
        found = self.edits.get((s, t))
        if found is None:
            found = []
            for c, a in self.arcs[s]:
                found += [(c + rest, d + rest) for d, b in self.arcs[t] if d != c for rest in self.both(a, b)]
                found += [(c + rest, rest) for rest in self.both(a, t) if rest[:1] != c]
            for d, b in self.arcs[t]:
                found += [(rest, d + rest) for rest in self.both(s, b) if rest[:1] != d]
            self.edits[s, t] = found
        return found

    def pairs(self, s: int, t: int) -> Iterator[tuple[str, str]]:
        """Pairs one edit apart, the first accepted from s, the second from t."""
        todo = [("", s, t)]
        while todo:
            read, s, t = todo.pop()
            for x, y in self.edited(s, t):
                yield read + x, read + y
            other = dict(self.arcs[t])
            todo += [(read + c, a, other[c]) for c, a in self.arcs[s] if c in other]


def initial_states(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(head, shorter, piece, word, n): a row per initial state of a word."""
    length = F.length("word")

    def row(head: bool, shorter: Column) -> Column:
        half = F.floor(shorter / 2).cast("int")
        piece = F.col("word").substr(F.lit(1), half) if head else F.col("word").substr(length - (shorter - half) + 1, shorter - half)
        return F.struct(F.lit(head).alias("head"), shorter.alias("shorter"), piece.alias("piece"))

    states = F.array(*(row(head, length - less) for less in (0, 1) for head in (True, False)))
    return words.select("word", "n", F.explode(states).alias("s")).select("s.*", "word", "n").filter(F.col("shorter") >= min_length)


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): each word with each word one edit away."""
    state, group = ["head", "shorter", "piece"], ["head", "shorter", "piece", "i", "j"]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group, RUN_WORDS):
            machine = Acceptor()
            words, n, part = (table[c].to_pylist() for c in ("word", "n", "part"))
            heads, shorter = table["head"].to_pylist(), table["shorter"].to_pylist()
            number = dict(zip(words, n, strict=True))
            found: list[tuple[str, str]] = []
            blocks = (table["i"].to_numpy() != table["j"].to_numpy()).tolist()
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if len(set(part[a:b])) == 1 + blocks[a]:
                    found += met(machine, heads[a], shorter[a], words[a:b], part[a:b])
            left, right = [x for x, _ in found], [y for _, y in found]
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(left, pa.string()), "near": pa.array(right, pa.string()),
                "near_n": pa.array([number[y] for y in right], pa.int64()),
            })

    def met(machine: Acceptor, head: bool, shorter: int, words: list[str], part: list[int]) -> list[tuple[str, str]]:
        half = shorter // 2
        behind = shorter - half

        def acceptor(own: list[str]) -> int:
            return machine.initial(sorted(w[half:] if head else w[: len(w) - behind] for w in own))

        first, last = min(part), max(part)
        if shorter > LONG:
            apart = [(x, y) for x in words for y in words if min(len(x), len(y)) == shorter and one_edit(x, y)]
            # a pair of one part belongs to the part's own group, one with equal first halves to that half's state
            split, whole = dict(zip(words, part, strict=True)), first == last
            return [(x, y) for x, y in apart if (whole or split[x] != split[y]) and (head or x[:half] != y[:half])]
        s = acceptor([w for w, p in zip(words, part, strict=True) if p == first])
        t = s if first == last else acceptor([w for w, p in zip(words, part, strict=True) if p == last])
        piece = words[0][:half] if head else words[0][len(words[0]) - behind :]
        remaining = shorter - len(piece)
        found = []
        for x, y in machine.pairs(s, t):
            # pairs of longer words belong to their own length, pairs with equal first halves to that half's state
            if min(len(x), len(y)) == remaining and (head or x[:half] != y[:half]):
                found.append((piece + x, piece + y) if head else (x + piece, y + piece))
        return found if first == last else found + [(y, x) for x, y in found]

    rows = initial_states(words, min_length)
    large = stored(rows.groupBy(*state).agg(F.count("*").alias("held")).filter(F.col("held") > block), "spelling-large")
    parts = F.ceil(F.coalesce("held", F.lit(1)) / block).cast("int")
    dealt = rows.join(large, state, "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(*state, F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "word", "n")
    return together(dealt, group).mapInArrow(compose, "word string, near string, near_n long")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root): each word's form, that form's form and so on, to the last."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = stored(roots.join(further, "root", "left"), "spelling-roots")
        roots = joined.select("word", F.coalesce("further", "root").alias("root"))
        if joined.filter("further IS NOT NULL").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the vocabulary."""
    words = stored(vocabulary(docs, min_length, min_count), "spelling-words")
    near = near_words(words, min_length, block)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    judged = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = roots_of(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
