"""Token classes, and which angle brackets enclose type arguments.

Comparing small numbers keeps the generated code short enough for the JIT compiler; the
texts themselves are rarely needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskweave.functions import constants as K

LPAREN, LBRACKET, LBRACE, RPAREN, RBRACKET, RBRACE = 1, 2, 3, 4, 5, 6
SEMICOLON, COMMA, DOT, COLONS, ASSIGN, PLUS, MINUS, PLUS_ASSIGN, STEP, LOOSER, AT, OTHER = range(7, 19)
ID, PRIMITIVE, RECORD, STRING, TEXT, CHAR, NUMBER = range(20, 27)
NEW, FOR, WHILE, DO, TRY, CATCH, FINALLY, ELSE, CLASS, INTERFACE, THROWS, SELF, LITERAL, KEYWORD, IF, EXTENDS = range(30, 46)
BEGIN, END, EOF, BAD, NOTHING = range(50, 55)
LANGLE, RANGLE, WILDCARD, AMPERSAND = range(60, 64)

_CLASS_OF_TOKEN = {
    **{word: KEYWORD for word in K.JAVA_KEYWORDS}, **{word: PRIMITIVE for word in K.JAVA_PRIMITIVES},
    **{op: LOOSER for op in K.LOOSER_THAN_PLUS},
    "(": LPAREN, "[": LBRACKET, "{": LBRACE, ")": RPAREN, "]": RBRACKET, "}": RBRACE,
    ";": SEMICOLON, ",": COMMA, ".": DOT, "::": COLONS, "=": ASSIGN, "+": PLUS, "-": MINUS, "+=": PLUS_ASSIGN,
    "++": STEP, "--": STEP, "@": AT, "record": RECORD, "<": LANGLE, ">": RANGLE, "?": WILDCARD, "&": AMPERSAND,
    "new": NEW, "for": FOR, "while": WHILE, "do": DO, "try": TRY, "catch": CATCH, "finally": FINALLY,
    "else": ELSE, "if": IF, "class": CLASS, "interface": INTERFACE, "throws": THROWS, "this": SELF, "super": SELF,
    "true": LITERAL, "false": LITERAL, "null": LITERAL, "extends": EXTENDS,
}
_CLASS_OF_KIND = {"word": ID, "string": STRING, "text": TEXT, "char": CHAR, "number": NUMBER, "eof": EOF, "bad": BAD}
OPENING, CLOSING = [LPAREN, LBRACKET, LBRACE], [RPAREN, RBRACKET, RBRACE]
#: Operators that bind more loosely than a plus.
LOOSE = [LOOSER, LANGLE, RANGLE, WILDCARD, AMPERSAND, ASSIGN, PLUS_ASSIGN]


def is_class(column: str, *classes: int) -> str:
    return f"({column} in ({', '.join(map(str, classes))}))"


def token_class() -> str:
    """SQL text of the class of a token, null for white space and comments; one lookup in a constant map."""
    pairs = ", ".join(f"'{tok}', {number}" for tok, number in _CLASS_OF_TOKEN.items())
    rest = " ".join(f"when '{kind}' then {number}" for kind, number in _CLASS_OF_KIND.items())
    known = (f"coalesce(if(kind in ('word', 'op'), try_element_at(map({pairs}), tok), null),"
             f" case kind {rest} else {OTHER} end)")
    return f"if(kind in ('space', 'comment'), null, {known})"


def with_type_turns(rows: DataFrame) -> DataFrame:
    """Add ``turn``: 1 where type arguments open, -1 where they close, else 0.

    ``rows``: file_id, lvl (brackets that are open), place (order in the file), k (class; null
    for what stands between tokens) and nth (number of tokens so far). A bracket is a row of
    its outer level and a begin or end mark of its inner one.

    Angle brackets pair like others: an opening one and the next one of its angle level are
    a pair if that closes, whatever the depth. A pair holds type arguments if each token between
    can follow the one before it there. The arguments of annotations are one level
    further in and not looked at. A comparison fails the test or has no partner.
    """
    level = "partition by file_id, lvl order by place"
    so_far = f"over ({level} rows between unbounded preceding and current row)"
    earlier = f"over ({level} rows between unbounded preceding and 1 preceding)"

    def latest(condition: str) -> str:
        return f"coalesce(max(if({condition}, place, null)) {so_far}, -1)"

    names = (ID, RECORD)
    ends = (*names, PRIMITIVE, RBRACKET, RANGLE)
    annotation = "l_at = l_other and l_at >= 0"  # the names before go back to an at sign
    allowed = {
        COMMA: is_class("k1", *ends, WILDCARD),
        DOT: is_class("k1", *names, RANGLE),
        WILDCARD: f"({is_class('k1', LANGLE, COMMA, RPAREN)} or ({is_class('k1', *names)} and {annotation}))",
        AMPERSAND: f"({is_class('k1', *ends)} and l_extends > l_border)",
        EXTENDS: is_class("k1", *names, WILDCARD),
        SELF: is_class("k1", WILDCARD),
        LPAREN: annotation, RPAREN: annotation,
        LBRACKET: is_class("k1", *ends), RBRACKET: "nth = nth1 + 1",
        LANGLE: is_class("k1", *names),
        RANGLE: f"({is_class('k1', *ends, WILDCARD, LANGLE)} and not {is_class('n1', NUMBER, STRING, TEXT, CHAR, LITERAL, NEW, PLUS, MINUS)})",
    }
    cases = " ".join(f"when {k} then int(not {condition})" for k, condition in allowed.items())
    same_level = "over (partition by file_id, lvl, angle order by place)"
    return (
        rows.selectExpr(
            "*", f"coalesce(last(k, true) {earlier}, {NOTHING}) as k1", f"last(if(k is null, null, nth), true) {earlier} as nth1",
            f"coalesce(lead(k) ignore nulls over ({level}), {NOTHING}) as n1",
            f"{latest(f'k = {AT}')} as l_at", f"{latest(f'k = {EXTENDS}')} as l_extends",
            f"{latest('not ' + is_class('k', *names, DOT, LPAREN, RPAREN))} as l_other",
            f"{latest(is_class('k', SEMICOLON, LPAREN, RPAREN, LBRACE, RBRACE, ASSIGN, BEGIN, END))} as l_border")
        .selectExpr(
            "*", f"sum(case when k is null or {is_class('k', *names, PRIMITIVE, AT)} then 0"
            f" else case k {cases} else 1 end end) {so_far} as unfit",
            f"sum(case k when {LANGLE} then 1 when {RANGLE} then -1 else 0 end) {so_far} as angles")
        .drop("k1", "nth1", "n1", "l_at", "l_other", "l_extends", "l_border")
        .selectExpr("*", f"case k when {LANGLE} then angles when {RANGLE} then angles + 1 end as angle")
        .selectExpr(
            "*", f"case when k = {LANGLE} and lead(k) {same_level} = {RANGLE} and lead(unfit) {same_level} = unfit then 1"
            f" when k = {RANGLE} and lag(k) {same_level} = {LANGLE} and lag(unfit) {same_level} = unfit then -1 else 0 end as turn")
        .drop("unfit", "angles", "angle")
    )
