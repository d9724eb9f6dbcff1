"""Token table: one row per lexical token of every file.

The whole file is cut by one alternation inside ``regexp_extract_all``; the
pieces join back to the input.  Every repetition of an alternation is
possessive, so a long literal is matched in a loop and not by recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.classes import BEGIN, END, token_class, with_type_turns

BLANKS = " \t\n\r\f"
_NAME = r"[\p{L}_$][\p{L}\p{M}\p{N}_$]*+"

# most tokens are words and blanks; nothing else begins like them, so they can be tried first
TOKEN_PATTERN = "|".join([
    _NAME,                                                          # word
    r"[ \t\n\r\f]+",                                                # white space
    r"/\*(?s:.*?)\*/",                                              # block comment
    r"/\*(?s:.*)",                                                  # comment never closed
    r"//[^\n\r]*",                                                  # line comment
    r'"""(?:[^"\\]++|\\(?s:.)|"{1,2}[^"\\]|"{1,2}\\(?s:.))*+"""',   # text block
    r'"(?:[^"\\\n\r]++|\\[^\n\r])*+"',                              # string
    r"'(?:[^'\\\n\r]++|\\[^\n\r])*+'",                              # character
    r"0[xX][0-9A-Fa-f_.]+(?:[pP][+-]?[0-9_]+)?[lLfFdD]?",           # hexadecimal number
    r"0[bB][01_]+[lL]?",                                            # binary number
    r"(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[lLfFdD]?",
    r"\.\.\.|->|::|\+\+|--|<<=|<<|&&|\|\||[-+*/%&|^=!<>]=",         # long operators
    r"(?s:.)",                                                      # anything else
])


def token_kind(tok: Column, first: Column) -> Column:
    """Kind of a token; ``first`` is the code of its first character, worked out once."""
    long = F.length(tok) > 1
    letter = first.between(ord("a"), ord("z")) | first.between(ord("A"), ord("Z")) | first.isin(ord("_"), ord("$"))
    return (
        F.when(letter, "word")
        .when(first.isin(*map(ord, " \t\n\r\f")), "space")
        .when(first == ord('"'), F.when(tok.startswith('"""') & (F.length(tok) >= 6), "text")
              .when(long, "string").otherwise("bad"))
        .when(first == ord("'"), F.when(long, "char").otherwise("bad"))
        .when(first.between(ord("0"), ord("9")), "number")
        .when((first == ord(".")) & long & (tok != "..."), "number")
        .when((first == ord("/")) & tok.startswith("//"), "comment")
        .when((first == ord("/")) & tok.startswith("/*"),
              F.when(tok.endswith("*/") & (F.length(tok) >= 4), "comment").otherwise("bad"))
        .when((first == 0) & (tok == ""), "eof")
        .when((first >= 128) & F.substring(tok, 1, 1).rlike(r"\p{L}"), "word")  # no operator needs the pattern
        .otherwise("op")
    )


def breaks_in(text: Column) -> Column:
    breaks = F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
    return F.when(breaks, F.regexp_count(text, F.lit("\r\n|\r|\n"))).otherwise(0)


def line_breaks(tok: Column, kind: Column) -> Column:
    return F.when(kind.isin("space", "comment", "text", "bad"), breaks_in(tok)).otherwise(0)


def bracket_step(tok: Column, kind: Column) -> Column:
    return (
        F.when(kind != "op", 0)
        .when(tok.isin("(", "[", "{"), 1)
        .when(tok.isin(")", "]", "}"), -1)
        .otherwise(0)
    )


#: Bytes of text that one task cuts into tokens; tokens and their windows take some thirty times as much memory.
TASK_BYTES = 16 << 20


def parts_for(files: DataFrame) -> int:
    """Number of parts that the files are cut up in, so that a part's size does not grow with their number."""
    total = files.agg(F.sum(F.octet_length("src"))).first()[0] or 0
    return max(files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))


def spread_files(files: DataFrame, about: list[str] | None = None, in_buckets: bool = False, parts: int | None = None) -> DataFrame:
    """Files hashed by ``file_id``, before they are cut into tokens; ``about`` names further narrow columns.

    Moving the text once is several times cheaper than moving its tokens; all
    later windows, groupings and the join back to the text keep this layout.
    The null test is spelled out so that both readers of the exchange, tokens
    and text, have the same plan and share it; the gates reject files without id.
    Files that lie in buckets of their id (``sources.bucketed``) are where they belong already.
    The number of parts goes by the size of the texts: merged by the size of this exchange,
    they would hold far more tokens than a task has memory for; ``parts`` names it if it is known.
    """
    known = files.select("file_id", "src", *(about or [])).where("file_id is not null")
    return known if in_buckets else known.repartition(parts or parts_for(known), "file_id")


def cut(files: DataFrame) -> DataFrame:
    """(file_id, pos, tok, kind), with one closing ``eof`` row per file."""
    pieces = F.regexp_extract_all(F.coalesce(F.col("src"), F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))
    return (
        files.select("file_id", F.posexplode(F.concat(pieces, F.array(F.lit("")))).alias("pos", "tok"))
        .select("file_id", "pos", "tok", F.ascii("tok").alias("first"))
        .select("file_id", "pos", "tok", token_kind(F.col("tok"), F.col("first")).alias("kind"))
    )


def cut_with_blanks(files: DataFrame) -> DataFrame:
    """(file_id, pos, tok, kind, piece): like ``cut``, but the white space behind a token is part of its row.

    ``piece`` is the token with that white space. A third of all tokens is white space, which
    decides nothing but places; only what a file begins with has a row of its own. A comment's ``tok`` is cut
    short by blanks at its end.
    """
    pieces = F.regexp_extract_all(F.coalesce(F.col("src"), F.lit("")), F.lit(f"(?:{TOKEN_PATTERN})[{BLANKS}]*+"), F.lit(0))
    return (
        files.select("file_id", F.posexplode(F.concat(pieces, F.array(F.lit("")))).alias("pos", "piece"))
        .select("file_id", "pos", "piece", F.ascii("piece").alias("first"), F.rtrim("piece", F.lit(BLANKS)).alias("tok"))
        .select("file_id", "pos", "tok", token_kind(F.col("tok"), F.col("first")).alias("kind"), "piece")
    )


def up_to_here() -> Window:
    return (Window.partitionBy("file_id").orderBy("pos")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def token_table(files: DataFrame, in_buckets: bool = False) -> DataFrame:
    """(file_id, pos, tok, line, kind, depth); depth counts open brackets, own bracket included.

    Tokens of type arguments, from the opening to the closing angle bracket, are of kind
    ``generic``, whatever the depth of nesting and with the arguments of annotations.
    """
    tokens = cut(spread_files(files, in_buckets=in_buckets)).selectExpr(
        "*", f"{token_class()} as k").select(
        "*", line_breaks(F.col("tok"), F.col("kind")).alias("breaks"), bracket_step(F.col("tok"), F.col("kind")).alias("step"))
    opened, lines = F.sum("step").over(up_to_here()), F.sum("breaks").over(up_to_here())
    placed = tokens.where(F.col("kind") != "eof").select(
        "file_id", "pos", F.col("pos").alias("place"), "tok", "kind", "k", "step",
        (1 + lines - F.col("breaks")).cast("int").alias("line"),
        (opened + F.when(F.col("step") < 0, 1).otherwise(0)).cast("int").alias("depth"),
        F.count("k").over(up_to_here()).alias("nth"),
    )
    # a bracket is a child of the level around it and a border of its own
    mark = f"struct(depth as lvl, if(step > 0, {BEGIN}, {END}) as k, true as mark)"
    levels = placed.selectExpr(
        "file_id", "pos", "place", "tok", "kind", "line", "depth", "nth",
        "inline(if(step = 0, array(struct(depth as lvl, k, false as mark)), array(struct(depth - 1 as lvl, k, false as mark), " + mark + ")))")
    turned = with_type_turns(levels).where("not mark")
    inside = (F.sum("turn").over(up_to_here()) > 0) | (F.col("turn") < 0)
    return turned.select(
        "file_id", "pos", "tok", "line", F.when(inside & ~F.col("kind").isin("space", "comment"), "generic").otherwise(F.col("kind")).alias("kind"), "depth")
