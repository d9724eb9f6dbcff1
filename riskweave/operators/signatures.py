"""Text signatures, all tested in one projection, in time linear in the text.

A yes/no search needs much less than a pattern's matches. Between its parts a signature
allows any run without one certain character (``;`` or a closing parenthesis), so a match lies
inside one stretch between two of these, and there the first call, the first keyword
behind it and any plus behind that decide. The patterns below begin at the border of a stretch
and take each part atomically: a stretch that fails is left at once, and every character is
read a few times at most. The signature on loops remembers more than a stretch; it is a
fold over the few tokens that matter.

The plain patterns are in ``constants.SIGNATURES``; tests hold both against each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import constants as K

#: Signature -> alternatives that find the same texts as its plain pattern; others are linear as they are.
LINEAR = {
    "SQL_INJECTION": [
        r"(?is)(?:\A|(?<=;))(?>[^;]*?(?:executeQuery|executeUpdate|execute|createQuery|createNativeQuery)\s*+\()"
        r"(?>[^;]*?\b(?:SELECT|INSERT\s++INTO|UPDATE|DELETE\s++FROM)\b)[^;+]*+\+"],
    # a run of word characters is tried once, from its first such word
    "HARDCODED_SECRET": [
        r"(?i)(?<!\w)(?>\w*?(?:password|passwd|pwd|secret|api_?key|token|credential))\w*+\s*+=\s*+\"[^\"]{3,}+\""],
    "COMMAND_INJECTION": [
        r"(?i)(?:\A|(?<=\)))(?>(?<=Runtime\.getRuntime\(\))\.exec\s*+\(|[^)]*?ProcessBuilder\s*+\()[^)+]*+\+"],
    "PATH_TRAVERSAL": [
        r"(?i)(?:\A|(?<=\)))(?>[^)]*?new\s++(?:File|FileInputStream|FileReader)\s*+\()[^)+]*+\+"],
    "EMPTY_CATCH_BLOCK": [
        r"(?:\A|(?<=\)))(?>[^)]*?catch\s*+\()[^)]*+\)\s*+\{\s*+\}"],
    "NULL_POINTER_RISK": [
        r"\.get\(\s*+\)\s*+\.\w++\(",
        r"(?:\A|(?<=\)))(?>[^)]*?\bgetParameter\()[^)]*+\)\s*+\.\w++\("],
}
_PATTERNS = {name: LINEAR.get(name, [pattern]) for name, pattern, _, _ in K.SIGNATURES}

#: What decides about a text appended to in a loop.
LOOP_TOKENS = r"""for\s*+\(|\)(?:\s*+\{)?|\}|;|["']|\w\s*+\+="""
#: Bits of the fold: behind a loop's bracket, inside a loop's body, behind an append of this statement, found.
HEADER, BODY, APPENDED, FOUND = 1, 2, 4, 8


def appends_in_loop(text: Column) -> Column:
    """A body of a ``for``, up to its first closing brace, with ``+=`` and a quote before the next semicolon."""
    def without(state: Column, bit: int) -> Column:
        return state.bitwiseAND(~bit)

    def step(state: Column, token: Column) -> Column:
        def has(bit: int) -> Column:
            return state.bitwiseAND(bit) > 0

        return (
            F.when(has(FOUND), state)
            .when(token == ";", without(state, APPENDED))
            .when(token == "}", without(state, BODY))
            .when(token.isin('"', "'"), F.when(has(APPENDED), F.lit(FOUND)).otherwise(state))
            .when(token.startswith("for"), state.bitwiseOR(HEADER))
            .when(token == ")", without(state, HEADER))
            .when(token.startswith(")"), F.when(has(HEADER), without(state, HEADER).bitwiseOR(BODY)).otherwise(state))
            .otherwise(F.when(has(BODY), state.bitwiseOR(APPENDED)).otherwise(state))
        )

    tokens = F.regexp_extract_all(text, F.lit(LOOP_TOKENS), F.lit(0))
    return F.aggregate(tokens, F.lit(0), step) == FOUND


def matches(text: Column, vulnerability_type: str) -> Column:
    """Does the text match the signature?  Cheap literals are tested first."""
    found = F.lit(True)
    for needle in K.SIGNATURE_GUARDS[vulnerability_type]:
        found = found & text.contains(needle)
    if vulnerability_type == "STRING_CONCAT_IN_LOOP":
        return F.coalesce(found & appends_in_loop(text), F.lit(False))
    any_of = F.lit(False)
    for pattern in _PATTERNS[vulnerability_type]:
        any_of = any_of | text.rlike(pattern)
    return F.coalesce(found & any_of, F.lit(False))


def signature_hits(text: Column) -> Column:
    """ARRAY<STRUCT<sig_seq, vulnerability_type, severity>> of the matching signatures."""
    return F.array_compact(F.array(*[
        F.when(matches(text, name),
               F.struct(F.lit(seq).alias("sig_seq"), F.lit(name).alias("vulnerability_type"),
                        F.lit(severity).alias("severity")))
        for seq, (name, _, severity, _) in enumerate(K.SIGNATURES, 1)
    ]))


def signature_scan(rows: DataFrame, text_col: str, key_cols: list[str]) -> DataFrame:
    """One row per key and matching signature; a narrow projection, no exchange."""
    return rows.select(*key_cols, F.explode(signature_hits(F.col(text_col))).alias("hit")).select(
        *key_cols, "hit.*")


def one_signature(rows: DataFrame, vulnerability_type: str, text_col: str, key_cols: list[str]) -> DataFrame:
    return rows.where(matches(F.col(text_col), vulnerability_type)).select(*key_cols)


def signature_stats(rows: DataFrame, text_col: str, by: list[str]) -> DataFrame:
    """Rows and hits per signature for every group, combined before the exchange."""
    flagged = rows.select(*by, *[
        matches(F.col(text_col), name).cast("int").alias(name.lower()) for name in _PATTERNS])
    return flagged.groupBy(*by).agg(
        F.count("*").alias("n_texts"),
        *[F.sum(name.lower()).alias(name.lower()) for name in _PATTERNS],
    )
