"""Program structure by windows over the token table.

``code_sites`` reduces every file to the few rows that matter (methods,
classes, loops, tries, catches, declarators, watched calls) in one pass.  The
text is hashed by ``file_id`` once; windows, groupings and the join back to the
text all keep that layout, so no second exchange is needed.

Two orders are used.  *File order* carries lines, offsets and depth.  *Level
order* puts the direct children of a bracket next to each other: an opening and
its closing bracket are neighbours there, whatever lies between them.  Every
bracket also leaves a ``<begin>`` and an ``<end>`` mark one level further in,
which separates the groups of one level.

One file is one window partition; the size gate bounds it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from riskweave.functions import constants as K
from riskweave.functions.columns import literal_array, method_hint
from riskweave.operators.classes import (
    ASSIGN, AT, BAD, BEGIN, CATCH, CHAR, CLASS, CLOSING, COLONS, COMMA, DO, DOT, ELSE, END, EOF, FINALLY, FOR, ID, IF, INTERFACE, LBRACE,
    LBRACKET, LITERAL, LOOSE, LPAREN, MINUS, NEW, NOTHING, NUMBER, OPENING, PLUS, PLUS_ASSIGN, PRIMITIVE, RBRACE, RBRACKET, RECORD, RPAREN,
    SELF, SEMICOLON, STEP, STRING, TEXT, THROWS, TRY, WHILE, is_class, token_class, with_type_turns,
)
from riskweave.operators.lexer import bracket_step, breaks_in, cut_with_blanks, parts_for, spread_files
from riskweave.plans.stage import staged

WATCHED_NAMES = sorted({*K.SQL_CALLS, "exec", "getInstance", "ProcessBuilder", *K.FILE_TYPES, *K.CLOSEABLE_TYPES})

# A place is one number that orders tokens and holds the character offset and
# the line: offset * 2**31 + line.  The latest place is then simply a maximum.
_OFFSET = "cast(shiftright({0}, 31) as int)"
_LINE = "cast({0} & 2147483647 as int)"

# the columns of one site; a call collects its arguments under the same key
SITE_FIELDS = {
    "kind": "string", "key": "bigint", "pos": "int", "end_pos": "int", "line": "int", "end_line": "int",
    "c1": "int", "name_pos": "int", "name_end": "int", "is_new": "boolean", "value": "string",
    "has_plus": "boolean", "breaks_line": "boolean", "looped": "boolean", "owner": "int", "reason": "string", "gap_pos": "int",
}
KIND_CODES = {"call": 1, "arg": 12, "eof": 2, "problem": 3, "init": 4, "catch": 5, "append": 6,
              "method": 7, "class": 8, "loop": 9, "try": 10, "resources": 11}
SPANS = ["method", "class", "loop", "try", "resources"]

_LEVEL = "over (partition by file_id, lvl order by place)"
_EARLIER = "over (partition by file_id, lvl order by place rows between unbounded preceding and 1 preceding)"
_UNTIL_HERE = "over (partition by file_id order by pos rows between unbounded preceding and 1 preceding)"
_SO_FAR = "over (partition by file_id order by pos rows between unbounded preceding and current row)"


def _level_rows(files: DataFrame) -> DataFrame:
    """Significant tokens in level order, with their begin and end marks."""
    tok, kind = F.col("tok"), F.col("kind")
    # a comment, a text block or a block is printed on lines of its own; the braces of an
    # array are not a block's (those inside of them are left to the outer ones)
    before = f"coalesce(last(k, true) {_UNTIL_HERE}, {NOTHING})"
    tokens = cut_with_blanks(files).select(
        "file_id", "pos", "tok", "kind", "piece", breaks_in(F.col("piece")).alias("breaks"), bracket_step(tok, kind).alias("step"),
    ).selectExpr(
        "file_id", "pos", "breaks", "step", "tok", "length(piece) as size", "length(tok) as own", "kind = 'comment' as noted", f"{token_class()} as k",
        "int(kind in ('string', 'text', 'char') and contains(tok, '\"')) as quoting",
    ).selectExpr(
        "file_id", "pos", "breaks", "step", "size", "own", "k", "quoting",
        f"if({is_class('k', ID, STRING, BAD)}, tok, null) as tok",  # the texts of comments and all others stop here
        f"int(noted or coalesce(k = {TEXT} or (k = {LBRACE} and not {is_class(before, RBRACKET, ASSIGN, COMMA, LBRACE)}), false)) as breaking",
    ).selectExpr(
        "file_id", "tok", "k", "step",
        f"int(sum(size) {_SO_FAR} - size + own) as c1",
        f"shiftleft(sum(size) {_SO_FAR} - size + 1, 31) + 1 + sum(breaks) {_SO_FAR} - breaks as place",
        f"int(sum(step) {_SO_FAR}) - if(step > 0, 1, 0) as lvl",
        f"int(sum(breaking) {_SO_FAR}) as broken",
        f"int(sum(quoting) {_SO_FAR}) as quoted",
        f"int(count(k) {_SO_FAR}) as nth",
    ).where("k is not null")
    mark = f"struct(lvl + 1 as lvl, if(step > 0, {BEGIN}, {END}) as k)"
    rows = tokens.selectExpr(
        "file_id", "tok", "place", "c1", "broken", "quoted", "nth", "k as bracket",
        f"inline(if(step = 0, array(struct(lvl, k)), array(struct(lvl, k), {mark})))")
    # type arguments decide nothing and are left out
    inside = "sum(turn) over (partition by file_id, lvl order by place rows between unbounded preceding and current row)"
    return with_type_turns(rows).selectExpr("*", f"{inside} as inside").where("inside = 0 and turn = 0").drop("turn", "inside")


def _neighbours(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "*",
        *[f"coalesce(lag(k, {n}) {_LEVEL}, {NOTHING}) as k{n}" for n in (1, 2, 3, 4)],
        *[f"coalesce(lead(k, {n}) {_LEVEL}, {NOTHING}) as n{n}" for n in (1, 2)],
        *[f"lag(place, {n}) {_LEVEL} as before{n}" for n in (1, 2, 3)],
        *[f"lead(place, {n}) {_LEVEL} as after{n}" for n in (1, 3)],
        f"lag(tok, 1) {_LEVEL} as tok1", f"lag(c1, 1) {_LEVEL} as tail_c1",
        f"lag(broken, 1) {_LEVEL} as tail_broken", f"lead(nth, 1) {_LEVEL} as after_nth",
    )


def _flags() -> dict[str, str]:
    """What a level-order row is, judged by its class and its neighbours' classes."""
    name1 = is_class("k1", ID, RECORD)
    after_type = f"(({is_class('k2', ID, PRIMITIVE)} and k3 != {AT}) or k2 = {RBRACKET})"
    linked = (
        f"({is_class('k', *CLOSING, DOT, COLONS)} or {is_class('k1', DOT, COLONS, NEW)}"
        f" or (k = {LPAREN} and {is_class('k1', ID, RECORD, SELF)})"
        f" or (k = {LBRACKET} and {is_class('k1', ID, RECORD, PRIMITIVE, RPAREN, RBRACKET)}))"
    )
    after_operand = is_class("k1", ID, RECORD, STRING, TEXT, CHAR, NUMBER, *CLOSING, SELF, CLASS, LITERAL, STEP)
    do_while = f"(k = {WHILE} and k1 = {RBRACE} and k2 = {LBRACE} and k3 = {DO})"
    loop_body_end = f"(k1 = {LBRACE} and k2 = {RPAREN} and k3 = {LPAREN} and {is_class('k4', FOR, WHILE)})"
    statement_end = f"(not {is_class('n1', ELSE, CATCH, FINALLY)} and not (n1 = {WHILE} and k2 = {DO}))"
    return {
        "boundary": is_class("k", BEGIN, SEMICOLON, RBRACE),
        "separator": is_class("k", END, COMMA, SEMICOLON),
        "group": f"k = {BEGIN}",
        "paren_group": f"k = {BEGIN} and bracket = {LPAREN}",
        "opening": is_class("k", *OPENING),
        "first": is_class("k1", NOTHING, BEGIN, SEMICOLON, RBRACE),
        "chain": f"not {linked}",
        "header": f"k = {LPAREN} and {name1} and {after_type} and n1 = {RPAREN} and {is_class('n2', LBRACE, THROWS, LBRACKET)}",
        "klass": f"{is_class('k', CLASS, INTERFACE)} and not {is_class('k1', DOT, AT)} and {is_class('n1', ID, RECORD)}",
        "loop_in": f"{is_class('k', FOR, WHILE)} and not {do_while}",
        # an else goes on with the loop only if its body began with an if
        "loop_out": (f"k = {BEGIN} or (k = {SEMICOLON} and (n1 != {ELSE} or l_if < l_loop_in))"
                     f" or (k = {RBRACE} and ({statement_end} or {loop_body_end}))"),
        "try_in": f"k = {TRY}",
        "try_out": f"k = {BEGIN} or (k = {RBRACE} and not {is_class('n1', CATCH, FINALLY)})",
        "newly": f"k = {NEW}",
        "plus": f"k = {PLUS} and {after_operand}",
        "minus": f"k = {MINUS} and {after_operand}",
        "looser": is_class("k", *LOOSE),
        "declared": (f"{is_class('k', ID, RECORD)} and ({is_class('k1', ID, PRIMITIVE)} or k1 = {RBRACKET})"
                     f" and {is_class('n1', ASSIGN, COMMA, SEMICOLON)}"),
        "typed_eq": f"k = {ASSIGN} and {name1} and {after_type}",
        "next_eq": f"k = {ASSIGN} and {name1} and k2 = {COMMA}",
    }


def _remembered(rows: DataFrame) -> DataFrame:
    """Running memories: place of the last boundary, header, operator ... before a row."""
    flags = _flags()

    def latest(condition: str, name: str, value: str = "place") -> str:
        return f"coalesce(max(if({condition}, {value}, null)) {_EARLIER}, -1) as {name}"

    rows = rows.selectExpr("*", latest(flags["loop_in"], "l_loop_in"), latest(f"k = {IF}", "l_if"))
    # the conditions stay inside the memories: as columns they would be carried through the windows
    start, equals = f"({flags['separator']} or {flags['group']})", f"({flags['typed_eq']} or {flags['next_eq']})"
    return rows.selectExpr(
        "*",
        *[latest(condition, f"l_{name}") for name, condition in flags.items() if name != "loop_in"],
        latest(start, "l_start"), latest(start, "l_start_broken", "broken"),
        latest(equals, "l_eq_broken", "broken"),
        latest(flags["typed_eq"], "l_typed_name", "before1"), latest(flags["next_eq"], "l_next_name", "before1"),
        latest(flags["header"], "l_header_name", "before1"), latest(flags["klass"], "l_klass_name", "after1"),
        f"lead(if({flags['separator']}, struct(before1 as tail, tail_c1 as c1, quoted), null)) ignore nulls {_LEVEL}"
        " as value_end",
    )


def _site(condition: str, start: str, end: str | None = None, end_c1: str | None = None,
          **fields: str) -> tuple[str, dict[str, str]]:
    """SQL text of one kind of site: when a row is one, and its columns.

    ``start`` and ``end`` are places of tokens; a closing bracket is one
    character, so it also is the last character.
    """
    given = {"pos": _OFFSET.format(start), "line": _LINE.format(start), **fields}
    if end:
        given |= {"end_pos": _OFFSET.format(end), "end_line": _LINE.format(end), "c1": end_c1 or _OFFSET.format(end)}
    return condition, given


def _sites(rows: DataFrame) -> DataFrame:
    at = _OFFSET.format
    plus_since = "(l_plus > {0} and l_minus < l_plus and l_looser <= {0})"
    terms = {  # each may use the ones before it
        "is_opening": _flags()["opening"], "is_separator": _flags()["separator"],
        # a further declarator counts when its statement began as a declaration
        "further": "(l_next_eq > l_typed_eq and l_declared > l_boundary)",
        "creation": "(l_newly >= l_chain and l_newly > l_opening)",
        "in_loop": "(l_loop_in > l_loop_out)", "in_try": "(l_try_in > l_try_out)",
        "holds_resources": f"(k = {LPAREN} and k1 = {TRY})",
        "literal": f"if(k1 = {STRING}, substring(tok1, 2, length(tok1) - 2), null)",
        "arg_plus": plus_since.format("l_start"),
        "arg_string": f"(k1 = {STRING} and {is_class('k2', BEGIN, COMMA)})",
        "mismatch": f"({is_class('k', *CLOSING)} and (lvl < 0 or k1 != k - 3))",
        "left_open": f"(k = {EOF} and lvl != 0)",
        "eq": "if(further, l_next_eq, l_typed_eq)", "eq_name": "if(further, l_next_name, l_typed_name)",
        "call_end": f"if(creation and n2 = {LBRACE}, after3, after1)",
        "init_plus": plus_since.format("eq"), "init_string": f"(k1 = {STRING} and before2 = eq)",
        "reason": f"""case when k = {BAD} then if(startswith(tok, '/*'), 'UNTERMINATED_COMMENT', 'UNTERMINATED_LITERAL')
            when mismatch then 'BRACKET_MISMATCH' when left_open then 'BRACKET_NOT_CLOSED' end""",
    }

    def spelt_out(expression: str) -> str:
        for term in reversed(terms):
            expression = re.sub(rf"\b{term}\b", lambda _, t=term: f"({terms[t]})", expression)
        return expression

    watched = ", ".join(f"'{name}'" for name in WATCHED_NAMES)
    argument = f"{is_class('k', END, COMMA)} and l_group = l_paren_group and (arg_plus or arg_string)"
    sites = {
        "eof": _site(f"k = {EOF}", "place"),
        "problem": _site(f"(k = {BAD} or mismatch or left_open)", "place", reason="reason"),
        "call": _site(f"k = {LPAREN} and k1 = {ID} and tok1 in ({watched})", "l_chain", "call_end",
                      is_new="creation", owner=at("place"), name_pos=at("before1"), name_end=at("place")),
        "arg": _site(argument, "(l_start + shiftleft(1L, 31))", c1="tail_c1", has_plus="arg_plus",
                     key=f"{at('l_group')} * 16L + {KIND_CODES['call']}", value="if(arg_string, literal, null)",
                     breaks_line="tail_broken > l_start_broken"),
        "init": _site("is_separator and eq > l_separator and (init_string or init_plus)", "eq_name",
                      "before1", "tail_c1", has_plus="init_plus", value="if(init_string, literal, null)",
                      name_pos=at("eq_name"), name_end=at("eq"), breaks_line="tail_broken > l_eq_broken"),
        "catch": _site(f"k = {LBRACE} and k1 = {RPAREN} and k2 = {LPAREN} and k3 = {CATCH} and after_nth = nth + 1",
                       "before3", "after1"),
        "append": _site(f"k = {PLUS_ASSIGN} and value_end.quoted > quoted", "l_chain",
                        "value_end.tail", "value_end.c1", looped="in_loop"),
        "method": _site(f"k = {LBRACE} and l_header > l_boundary", "l_first", "after1",
                        name_pos=at("l_header_name"), name_end=at("l_header"), gap_pos=f"{at('l_boundary')} + 1"),
        "class": _site(f"k = {LBRACE} and l_klass > l_boundary", "place", "after1",
                       name_pos=at("l_klass_name"), name_end=at("place")),
        "loop": _site("is_opening and in_loop", "place", "after1"),
        "try": _site("is_opening and in_try and not holds_resources", "place", "after1", owner=at("l_try_in")),
        "resources": _site("is_opening and in_try and holds_resources", "place", "after1", owner=at("l_try_in")),
    }
    # only these classes can be a site
    possible = is_class("k", *OPENING, *CLOSING, SEMICOLON, COMMA, END, PLUS_ASSIGN, EOF, BAD)
    bits = " + ".join(f"if({spelt_out(condition)}, {1 << KIND_CODES[kind]}, 0)" for kind, (condition, _) in sites.items())
    codes = f"filter(array({', '.join(map(str, KIND_CODES.values()))}), c -> getbit(kinds, c) = 1)"

    def column(name: str, ddl: str) -> str:
        own = {"kind": lambda kind: f"'{kind}'", "key": lambda kind: f"{at('place')} * 16L + {KIND_CODES[kind]}"}
        default = own.get(name, lambda kind: None)
        cases = {kind: fields.get(name, default(kind)) for kind, (_, fields) in sites.items()}
        whens = " ".join(f"when {KIND_CODES[kind]} then {value}" for kind, value in cases.items() if value)
        return f"cast({spelt_out(f'case code {whens} end')} as {ddl}) as {name}"

    # few rows are a site: which ones is decided by numbers, everything else is worked out for those only.
    # The test sits inside the generator because a filter would be carried through all the expressions it uses
    found = rows.selectExpr("*", f"if({possible}, {bits}, 0) as kinds").selectExpr("*", f"explode(if(kinds != 0, {codes}, null)) as code")
    # sorting these few rows ends the generated method that all rows run through; with the columns in it, it is too long for the JIT compiler
    return found.sortWithinPartitions("file_id", "place").selectExpr("file_id", *[column(name, ddl) for name, ddl in SITE_FIELDS.items()])


def _with_arguments(sites: DataFrame) -> DataFrame:
    """Fold the interesting arguments of a call into its site."""
    own = ", ".join(name for name in SITE_FIELDS if name != "key")
    return (
        sites.groupBy("file_id", "key")
        .agg(
            F.expr(f"max(if(kind != 'arg', struct({own}), null)) as own"),
            F.expr("array_sort(collect_list(if(kind = 'arg' and has_plus, struct(pos, c1, breaks_line), null)))"
                   " as plus_args"),
            F.expr("min(if(kind = 'arg' and value is not null, struct(pos, value), null)) as string_arg"),
        )
        .where("own is not null")
        .selectExpr("file_id", "own.*", "plus_args", "string_arg.value as string_arg")
    )


def _with_scope(sites: DataFrame) -> DataFrame:
    """Nearest enclosing method, class and try, and loop membership.

    Spans of one kind nest, so counting how many are open gives the nesting
    level, and the span around a row is the last one opened at its level.
    """
    spans = ", ".join(f"'{kind}'" for kind in SPANS)
    so_far = "rows between unbounded preceding and current row)"
    name = "struct(name_pos as pos, name_end as end)"

    def opened(condition: str) -> str:
        return f"sum(if({condition}, turn, 0)) over (partition by file_id order by at {so_far}"

    def nearest(level: str, condition: str, value: str) -> str:
        return (f"last(if({condition} and turn = 1, {value}, null), true)"
                f" over (partition by file_id, {level} order by at {so_far}")

    is_try = "kind in ('try', 'resources')"
    return (
        sites.selectExpr(
            "*", f"inline(if(kind in ({spans}), array(struct(pos as at, 1 as turn), struct(end_pos as at, -1 as turn)),"
            " array(struct(pos as at, 0 as turn))))")
        .selectExpr(
            "*", opened("kind = 'method'") + " as in_methods", opened("kind = 'class'") + " as in_classes",
            opened("kind = 'loop'") + " as in_loops", opened(is_try) + " as in_tries")
        .where("turn >= 0 and kind != 'loop'")
        .selectExpr(
            "*", "coalesce(looped, false) or in_loops > 0 as in_loop",
            nearest("in_methods", "kind = 'method'", name) + " as method_at",
            nearest("in_classes", "kind = 'class'", name) + " as class_at",
            nearest("in_tries", is_try, "owner") + " as try_pos")
        .where("kind != 'try'")
    )


def _with_text(sites: DataFrame, spread: DataFrame, about: list[str]) -> DataFrame:
    """Cut names and code out of the file's text; the end of a file has what is known about it."""
    # four bytes a character: the place of a piece is known, where a string would be counted through from its start
    # (exploded, so that a text is encoded once and not again for each of its sites)
    texts = spread.select("file_id", F.explode(F.array(F.encode(F.make_valid_utf8("src"), "UTF-32"))).alias("src"), *about)

    def piece(pos: Column, length: Column) -> Column:
        at = F.substring("src", F.when(pos > 0, 4 * pos - 3).otherwise(4 * pos), 4 * length)
        return F.substring(F.decode(F.concat(F.lit(b"\0\0\0A"), at), "UTF-32"), 2, 2**31 - 1)  # behind a letter no mark of byte order is dropped

    def word(pos: Column, end: Column) -> Column:
        return F.regexp_extract(piece(pos, end - pos), r"^[\p{L}\p{M}\p{N}_$]+", 0)

    has_code = F.col("kind").isin("call", "init", "catch", "append", "method", "resources")
    has_name = F.col("name_pos").isNotNull()
    # between the statement before and a method stand blanks, comments and its type parameters;
    # the last comment is the method's
    gap = piece(F.greatest("gap_pos", F.lit(1)), F.col("pos") - F.greatest("gap_pos", F.lit(1)))
    before = F.when(F.contains(gap, F.lit("/")) | F.contains(gap, F.lit("<")), F.regexp_extract(gap, K.METHOD_LEAD, 0))
    lead = F.when(F.col("kind") == "method", F.coalesce(before, F.lit(""))).otherwise("")
    sql_arg = F.exists("plus_args", lambda a: ~a["breaks_line"] & F.rlike(
        piece(a["pos"], a["c1"] - a["pos"] + 1), F.lit(K.SQL_WORDS)))
    return sites.join(texts, "file_id").select(
        "file_id", "kind", "pos", "end_pos", "line", "end_line", "is_new", "value", "breaks_line", "reason",
        "string_arg", "in_loop", "try_pos",
        F.when(has_code, F.concat(lead, piece(F.col("pos"), F.col("c1") - F.col("pos") + 1))).alias("code"),
        F.when(has_name, word(F.col("name_pos"), F.col("name_end"))).alias("name"),
        F.when(F.col("method_at").isNotNull(), word(F.col("method_at.pos"), F.col("method_at.end"))).alias("method_name"),
        F.when(F.col("class_at").isNotNull(), word(F.col("class_at.pos"), F.col("class_at.end"))).alias("class_name"),
        (F.col("name_pos") - F.col("pos")).alias("scope_chars"),
        (F.col("has_plus") | (F.size("plus_args") > 0)).alias("has_plus"),
        sql_arg.alias("sql_arg"),
        *[F.when(F.col("kind") == "eof", F.col(name)).alias(name) for name in about],
    )


def all_sites(files: DataFrame, about: list[str] | None = None, counts: dict[str, Column] | None = None,
              observation: Observation | None = None, in_buckets: bool = False, apart: bool = False) -> DataFrame:
    """Sites of every file, broken files included (see ``code_sites``).

    ``about``: columns of the files that the one ``eof`` site of each file carries, so that
    nothing has to be read from the files again. ``counts`` are observed on the way.
    ``in_buckets``: the files come from a table in buckets of ``file_id``, so no text is moved.
    ``apart``: the places of the sites are stored before their scopes and texts are worked out.
    An executor keeps some hundred compiled expressions; all steps together have more, so
    that every task would compile them anew.
    """
    about = about or []
    parts = None if in_buckets else parts_for(files.where("file_id is not null"))
    spread = spread_files(files, about, in_buckets, parts)
    # the counts use all columns, so tokens and text still read the same exchange
    used = {f"with_{name}": F.count(name) for name in about} | (counts or {})
    watched = spread.observe(observation or Observation(), *[c.alias(name) for name, c in used.items()]) if used else spread
    rows = _remembered(_neighbours(_level_rows(watched)))
    places = staged(_sites(rows), "places") if apart else _sites(rows)
    if apart and parts:  # dealt like the texts, which would be moved once more to meet them, in four bytes a character
        places = places.repartition(parts, "file_id")
    sites = _with_text(_with_scope(_with_arguments(places)), spread, about)
    same_try = Window.partitionBy("file_id", "try_pos")
    managed = F.filter(literal_array(K.CLOSEABLE_TYPES), lambda name: F.contains(F.col("code"), name))
    return (
        sites.withColumn("managed_types", F.coalesce(
            F.max(F.when(F.col("kind") == "resources", managed)).over(same_try),
            F.array().cast("array<string>")))
        .withColumn("broken", F.max(F.col("kind") == "problem").over(Window.partitionBy("file_id")))
    )


def code_sites(files: DataFrame, in_buckets: bool = False, apart: bool = False) -> DataFrame:
    """Sites of the files whose structure holds; the others are quarantined."""
    return all_sites(files, in_buckets=in_buckets, apart=apart).where(~F.col("broken"))


def first_problems(sites: DataFrame) -> DataFrame:
    """(file_id, line, reason) of the first problem of every broken file, from the sites of all files."""
    return (
        sites.where(F.col("kind") == "problem")
        .groupBy("file_id")
        .agg(F.min(F.struct("pos", "line", "reason")).alias("p"))
        .select("file_id", "p.line", "p.reason")
    )


def structure_quarantine(files: DataFrame) -> DataFrame:
    """(file_id, line, reason) of the first problem of every broken file."""
    return first_problems(_sites(_remembered(_neighbours(_level_rows(spread_files(files))))))


def nesting_groups(tokens: DataFrame) -> DataFrame:
    """One row per bracket pair of a token table.

    (file_id, open_pos, close_pos, bracket, open_line, close_line, callee,
    n_children, child_text); ``callee`` is the word right before the bracket.
    """
    significant = tokens.where(~F.col("kind").isin("space", "comment", "generic"))
    in_order = Window.partitionBy("file_id").orderBy("pos")
    is_op = F.col("kind") == "op"
    opens = is_op & F.col("tok").isin("(", "[", "{")
    rows = significant.select(
        "*", opens.alias("opens"),
        (is_op & F.col("tok").isin(")", "]", "}")).alias("closes"),
        F.lag("tok").over(in_order).alias("prev_tok"),
        F.lag("kind").over(in_order).alias("prev_kind"),
    )
    # a bracket belongs to the group it delimits and, as a child, to the group around it
    level = F.when(F.col("opens") | F.col("closes"), F.array(F.col("depth"), F.col("depth") - 1)).otherwise(
        F.array("depth"))
    rows = rows.select("*", F.posexplode(level).alias("as_child", "lvl"))
    rows = rows.withColumn("child", ~(F.col("opens") | F.col("closes")) | (F.col("as_child") == 1))
    by_level = Window.partitionBy("file_id", "lvl").orderBy("pos")
    delimits = F.col("opens") & ~F.col("child")
    rows = rows.withColumn("open_pos", F.last(F.when(delimits, F.col("pos")), ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = F.col("closes") & ~F.col("child")
    return (
        rows.where(F.col("open_pos").isNotNull() & (F.col("lvl") > 0))
        .groupBy("file_id", "open_pos")
        .agg(
            F.max(F.when(ends, F.col("pos"))).alias("close_pos"),
            F.max(F.when(delimits, F.col("tok"))).alias("bracket"),
            F.max(F.when(delimits, F.col("line"))).alias("open_line"),
            F.max(F.when(ends, F.col("line"))).alias("close_line"),
            F.max(F.when(delimits & (F.col("prev_kind") == "word"), F.col("prev_tok"))).alias("callee"),
            F.count(F.when(F.col("child"), 1)).cast("int").alias("n_children"),
            F.array_sort(F.collect_list(F.when(F.col("child"), F.struct("pos", "tok")))).alias("children"),
        )
        .withColumn("child_text", F.array_join(F.transform("children", lambda x: x["tok"]), " "))
        .drop("children")
    )


def method_snippets(sites: DataFrame) -> DataFrame:
    """One row per method with a body, inner methods before the outer one.

    (file_id, method_seq, class_name, method_name, code, start_line, end_line, hint)
    """
    by_end = Window.partitionBy("file_id").orderBy("end_pos")
    return sites.where(F.col("kind") == "method").select(
        "file_id",
        F.row_number().over(by_end).alias("method_seq"),
        F.coalesce("class_name", F.lit(K.NO_CLASS)).alias("class_name"),
        F.col("name").alias("method_name"),
        "code",
        F.col("line").alias("start_line"),
        "end_line",
        method_hint(F.col("code"), printed=True).alias("hint"),
    )


def attribute_scope(sites: DataFrame) -> DataFrame:
    """Nearest method and class of every finding place (calls, declarators, catches, appends)."""
    return sites.where(F.col("kind").isin("call", "init", "catch", "append")).select(
        "file_id", "kind", "pos", "line", "name",
        F.coalesce("method_name", F.lit(K.NO_METHOD)).alias("method_name"),
        F.coalesce("class_name", F.lit(K.NO_CLASS)).alias("class_name"),
    )


def snippet_cap(
    snippets: DataFrame, file_col: str = "file_id", seq_col: str = "method_seq", text_col: str = "code",
    max_n: int = K.MAX_SNIPPETS, max_chars: int | None = K.MAX_SNIPPET_CHARS,
) -> DataFrame:
    """The first ``max_n`` snippets of a file, each cut to ``max_chars`` (None: whole).

    The rank filter is applied per task before the exchange, so a file holding
    a large share of all snippets sends at most ``max_n`` rows per task.
    """
    in_file = Window.partitionBy(file_col).orderBy(seq_col)
    first = snippets.withColumn("snippet_rank", F.row_number().over(in_file)).where(F.col("snippet_rank") <= max_n)
    return first if max_chars is None else first.withColumn(text_col, F.substring(F.col(text_col), 1, max_chars))
