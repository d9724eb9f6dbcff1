"""Exact encoding of texts by the pieces between blanks.

Byte-level BPE first cuts a text into pre-tokens, and none reaches over a blank
except that a blank leads the word behind it. So a text whose blanks are single is
the concatenation of its pieces' encodings, each with its leading blank, and a piece
has to be encoded once only. A text in which a blank follows or precedes other white
space in a way that joins them into one pre-token is encoded as a whole.
"""

from __future__ import annotations

import os
import string
import sys
import types
from collections.abc import Callable
from itertools import islice
from typing import Any

from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

#: Pieces that a worker remembers.
REMEMBERED = 1_400_000

#: What a table gives for a piece that is not known, and for one inside a longer run of white space.
UNKNOWN, JOINED = object(), None


def library(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: its own where that prints, else one from 256 on."""
    letters = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    return letters | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in letters)}


def kept_in_worker(name: str, make: Callable[[], Any]) -> Any:
    """What the name stands for in this process; a Python worker serves many tasks."""
    store = sys.modules.setdefault("_corpus_worker", types.ModuleType("_corpus_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def parts(key: Any) -> list[Any]:
    """Keys of a piece's parts where they are plain: lines, and a word with punctuation behind it."""
    lead = key.__class__ is not tuple
    text = key if lead else key[0]
    word = text.rstrip(string.punctuation)
    if len(word) < len(text) and word.isalpha():
        return [word if lead else (word,), (text[len(word) :],)]
    line, feed, rest = text.partition("\n")
    if feed and line and rest and not line[-1].isspace() and not rest[0].isspace():
        return [line if lead else (line,), ("\n",), (rest,)]
    return []


class Table(dict):
    """Values of pieces that are one part; composed ones are added up, unknown parts are noted."""

    def __init__(self, known: dict[Any, Any]):
        super().__init__(known)
        self.asked: set[Any] = set()
        self.joined = False

    def __missing__(self, key: Any) -> Any:
        if key.__class__ is not tuple and (not key or key[0].isspace()):
            self.joined = True
            return JOINED
        split = parts(key)
        if not split:
            self.asked.add(key)
            return UNKNOWN
        values = [self[part] for part in split]
        if UNKNOWN in values:
            return UNKNOWN
        total = values[0]
        for value in values[1:]:
            total = total + value
        if len(split) == 2:  # a word that was known already: such pieces come back
            self[key] = total
        return total


class Pieces:
    """What ``value`` makes of ids, for pieces (remembered) and whole texts.

    Values of parts must add up (``+``) to the value of the whole. A key is a piece
    that a blank leads, or a tuple of one that stands without.
    """

    def __init__(self, tokenizer: Tokenizer, value: Callable[[list[int]], Any], known: dict[Any, Any] | None = None, remembered: int = REMEMBERED):
        self.tokenizer, self.value, self.known, self.remembered = tokenizer, value, known or {}, remembered
        self.table, self.letters = Table(self.known), byte_letters()
        added = tokenizer.get_added_tokens_decoder().values()
        # letters behind a blank are one pre-token of byte-level BPE, which its model takes as it is
        self.direct = (
            isinstance(tokenizer.model, BPE) and isinstance(tokenizer.pre_tokenizer, ByteLevel) and tokenizer.normalizer is None
            and not any(token.content.isalpha() for token in added)
        )

    def forget(self) -> None:
        """Drop the younger pieces of a full table; frequent ones are met early and stay."""
        if len(self.table) > len(self.known) + self.remembered:
            self.table = Table(dict(islice(self.table.items(), len(self.known) + 3 * self.remembered // 4)))

    def learn(self, keys: set[Any]) -> None:
        """Encode pieces that are one part."""
        words = [k for k in keys if k.__class__ is str and k.isalpha()] if self.direct else []
        model, letters = self.tokenizer.model, self.letters
        for word in words:
            self.table[word] = self.value([t.id for t in model.tokenize(f" {word}".encode().decode("latin-1").translate(letters))])
        rest = list(keys.difference(words))
        encoded = self.tokenizer.encode_batch_fast([k[0] if k.__class__ is tuple else f" {k}" for k in rest], add_special_tokens=False)
        self.table.update(zip(rest, (self.value(e.ids) for e in encoded), strict=True))

    def looked_up(self, keys: list[Any]) -> list[Any]:
        """The value of each key; ``JOINED`` for one inside a longer run of white space."""
        self.forget()
        found = list(map(self.table.__getitem__, keys))
        self.table.joined = False
        if self.table.asked:
            asked, self.table.asked = self.table.asked, set()
            self.learn(asked)
            now = self.table.__getitem__
            found = [now(k) if v is UNKNOWN else v for k, v in zip(keys, found, strict=True)]
        return found

    def values(self, texts: list[str]) -> list[list[Any]]:
        """For each text, values that add up to the whole text's."""
        self.forget()
        keys = [text.split(" ") for text in texts]
        for k in keys:
            k[0] = (k[0],)
        found = [list(map(self.table.__getitem__, k)) for k in keys]
        if self.table.asked:
            asked, self.table.asked = self.table.asked, set()
            self.learn(asked)
            now = self.table.__getitem__
            found = [[now(x) if v is UNKNOWN else v for x, v in zip(k, f, strict=True)] for k, f in zip(keys, found, strict=True)]
        if self.table.joined:
            self.table.joined = False
            for i, text in enumerate(texts):
                if JOINED in found[i]:
                    found[i] = [self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)]
        return found
