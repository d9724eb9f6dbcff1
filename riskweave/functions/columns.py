"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions import constants as K


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def sanitise_name(name: Column) -> Column:
    """Drop line breaks, tabs and angle brackets, shorten to 120 characters."""
    clean = F.translate(name, "\r\n\t<>", "")
    short = F.concat(F.substring(clean, 1, K.NAME_CHARS), F.lit("..."))
    return F.coalesce(F.when(F.length(clean) > K.NAME_CHARS, short).otherwise(clean), F.lit(""))


def truncate(text: Column, limit: int = K.STORED_SNIPPET_CHARS) -> Column:
    cut = F.concat(F.substring(text, 1, limit), F.lit(K.STORED_SNIPPET_SUFFIX))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def env_name(name: Column) -> Column:
    """dbPassword -> DB_PASSWORD"""
    return F.upper(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))


def severity_weight(severity: Column) -> Column:
    weight = F.when(F.lit(False), 0)
    for band, value in K.SEVERITY_WEIGHT.items():
        weight = weight.when(severity == band, value)
    return weight.otherwise(K.OTHER_WEIGHT).cast("int")


def score_band(score: Column) -> Column:
    band = F.when(F.lit(False), "")
    for floor, name in K.SCORE_BANDS:
        band = band.when(score >= floor, name)
    return band.otherwise(K.LOWEST_BAND)


def has_finding(vulnerability_type: Column) -> Column:
    """True for a type that is neither null, nor blank, nor NONE in any case."""
    blank = F.length(F.trim(F.translate(vulnerability_type, "\t\n\r\f", "    "))) == 0
    return F.coalesce(~blank & (F.upper(vulnerability_type) != "NONE"), F.lit(False))


def method_hint(code: Column, printed: bool = False) -> Column:
    """Comma-joined textual hints of a method, null when there are none.

    The hint on SQL asks for a text of one line. ``printed`` stands for the text as a
    pretty printer writes it: there a body with a statement has several lines.
    """
    one_line = code.rlike(K.EMPTY_BODY) if printed else ~code.rlike(r"[\n\r\x{85}\x{2028}\x{2029}]")
    sql = code.contains("+") & one_line & code.rlike(K.SQL_WORDS)
    secret = code.contains('"') & code.rlike(K.SECRET_WORDS)
    squeezed = F.regexp_replace(code, r"[ \t\n\x0B\f\r]+", "")
    swallowed = code.contains("catch") & squeezed.contains("){}")
    joined = F.concat_ws(
        ",",
        F.when(sql, "possible_sql_injection"),
        F.when(secret, "possible_hardcoded_secret"),
        F.when(swallowed, "possible_swallowed_exception"),
    )
    return F.nullif(joined, F.lit(""))


def hint_agrees(hint: Column, vulnerability_type: Column) -> Column:
    """Some non-empty hint part, without its prefix, occurs in the type."""
    parts = F.split(F.replace(F.lower(hint), F.lit("possible_"), F.lit("")), ",")
    agrees = F.exists(parts, lambda p: (p != "") & F.contains(F.lower(vulnerability_type), p))
    return F.coalesce(agrees, F.lit(False))


def with_hint_bonus(confidence: Column, hint: Column, vulnerability_type: Column) -> Column:
    raised = F.least(F.lit(1.0), confidence + F.lit(K.HINT_BONUS))
    return F.when(hint_agrees(hint, vulnerability_type), raised).otherwise(confidence)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two numeric arrays, null for a missing or zero vector."""
    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(norm > 0, dot(left, right) / norm)


def confidence_of(similarity: Column) -> Column:
    """Map a cosine to [0, 1]; neutral when there is none."""
    mapped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity + 1.0) / 2.0))
    return F.when(similarity.isNull() | F.isnan(similarity), F.lit(K.NEUTRAL_CONFIDENCE)).otherwise(mapped)


def percent(confidence: Column) -> Column:
    return F.floor(F.coalesce(confidence, F.lit(0.0)) * 100 + F.lit(0.5)).cast("int")
