"""Secret scans: known forms, and strings that a tokenizer can hardly shorten.

Three base kinds are found by pattern: a value assigned to a name such as
``password`` (6 characters or more), an access key (20 or more), and a run of
hexadecimal digits (24 or more). Matches are leftmost and do not overlap within a
kind; a span is the whole match, in code points.

The method adds the kind ``random``: a run of key characters that takes many tokens
for its length under a tiktoken vocabulary. Ordinary words take few tokens a
character; random strings have few pairs that the vocabulary knows. Digests of usual
lengths, UUIDs, numbers and words or joined words (identifiers, paths) that take few
tokens themselves are set aside first, and so are runs that touch a base span. Of a run
that as a whole is none, what is left between the words at its ends is tested, and then
each part between signs. Random runs of small letters only are found in part: they take
about as many tokens as long compounds of rare words.

Defined results: a null text is an empty one and has no spans (the digest of the
empty string); rows with null or repeated ids are scanned one by one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

# The base kinds in their order, with the shortest match that counts.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")

#: Runs that are tested by their tokens.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Characters per token up to which a run counts as random.
MAX_CHARS_PER_TOKEN = 2.0
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.IGNORECASE)
#: Parts of a joined name: a word in one case or capitalised, or a number.
NAME = re.compile(r"(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+)")
MIN_NAME_PART = 3
#: Characters per token that the words of a name have at least, each encoded alone.
NAME_CHARS_PER_TOKEN = 2.5
#: The same for one run of small letters: long compounds of rare words come near random ones.
LETTERS_PER_TOKEN = 1.75
MIN_RUN = 16
PART = re.compile(r"[A-Za-z0-9]+")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
Span = tuple[int, int, int]


def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of each base match, by start and kind."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_name(run: str, tokens: tiktoken.Encoding) -> bool:
    """Words or numbers, joined by signs or by capitals; short changes between kinds and words of many tokens are no name."""
    if run.isalpha() and (run.islower() or run.istitle()):
        return len(run) > LETTERS_PER_TOKEN * len(tokens.encode_ordinary(run))
    parts = PART.findall(run)
    pieces = [x for p in parts for x in NAME.findall(p)]
    words = [x for x in pieces if x.isalpha() and len(x) >= MIN_NAME_PART]
    if sum(map(len, words)) < NAME_CHARS_PER_TOKEN * sum(len(tokens.encode_ordinary(x)) for x in words):
        return False
    if all(p.isdigit() or p.isalpha() and (p.islower() or p.isupper() or p.istitle()) for p in parts):
        return True
    return sum(map(len, pieces)) >= MIN_NAME_PART * len(pieces)


def is_dense(run: str, tokens: tiktoken.Encoding) -> bool:
    """Many tokens for its length."""
    return len(run) <= MAX_CHARS_PER_TOKEN * len(tokens.encode_ordinary(run))


def is_random(run: str, tokens: tiktoken.Encoding) -> bool:
    return len(run) >= MIN_RUN and not DIGEST.fullmatch(run) and not UUID.fullmatch(run) and is_dense(run, tokens) and not is_name(run, tokens)


def random_parts(run: str, tokens: tiktoken.Encoding) -> list[tuple[int, int]]:
    """Ranges of a run that are random: all of it, what is left between words at its ends, or parts."""
    if DIGEST.fullmatch(run) or UUID.fullmatch(run):
        return []
    if is_random(run, tokens):
        return [(0, len(run))]
    parts = [m.span() for m in PART.finditer(run)]
    if len(parts) < 2 or max(b - a for a, b in parts) < MIN_RUN and len(run) < 2 * MIN_RUN:
        return []
    inner = [i for i, (a, b) in enumerate(parts) if not run[a:b].isdigit() and is_dense(run[a:b], tokens)]
    if inner:
        start, end = parts[inner[0]][0], parts[inner[-1]][1]
        if is_random(run[start:end], tokens):
            return [(start, end)]
    return [(a, b) for a, b in parts if is_random(run[a:b], tokens)]


def random_spans(text: str, base: list[Span], tokens: tiktoken.Encoding) -> list[Span]:
    """Random runs that no base span touches; both lists are in order, so one pass decides."""
    found = []
    passed, reach = 0, 0  # base spans that begin before the run's end, and where they end
    for m in CANDIDATE.finditer(text):
        while passed < len(base) and base[passed][0] < m.end():
            reach = max(reach, base[passed][2])
            passed += 1
        if reach > m.start():
            continue
        found += [(m.start() + a, 3, m.start() + b) for a, b in random_parts(m[0], tokens)]
    return found


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")}
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                added = random_spans(text or "", base, tokens)
                for kind, name in enumerate(("n_assign", "n_access", "n_hex")):
                    rows[name].append(sum(k == kind for _, k, _ in base))
                rows["n_random"].append(len(added))
                rows["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                rows["spans"].append(written(sorted(base + added)))
            kinds = {"base_sha256": pa.string(), "spans": pa.string()}
            columns = {name: pa.array(values, kinds.get(name, pa.int64())) for name, values in rows.items()}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64())} | columns)

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)
