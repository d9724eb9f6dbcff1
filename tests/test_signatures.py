"""Signatures: the same texts as their plain patterns, and time linear in the text."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from riskweave.functions import constants as K
from riskweave.operators.signatures import matches

# pieces out of which random texts are put together: all that some pattern looks at
PIECES = [
    "executeQuery", "execute", "Execute ", "createQuery", "(", ")", " (", ") ", ";", "+", "+=", " + ", " SELECT ", "select", "xselect ", "INSERT  INTO ",
    "insert", "update ", "DELETE FROM", "password", "apiKey", "api_key", "token", "x", " = ", "=", '"', "'", '"abc"', "ab", "MessageDigest.getInstance",
    '("MD5")', "Cipher.getInstance", '( "DES', "Runtime.getRuntime()", ".exec", "ProcessBuilder", "new ", "new\n", "File", "FileReader", "Socket", "catch", "{", "}",
    " {", "\n", " ", "for", "for (", "getParameter(", ".get(", ".a(", ".", "Connection",
]


def random_texts(seed: int, n: int) -> list[str]:
    pick = random.Random(seed)
    texts = []
    for _ in range(n):
        # a few pieces at a time, so that whole signatures come about
        few = pick.sample(PIECES, pick.randint(4, 14))
        texts.append("".join(pick.choice(few) for _ in range(pick.randint(1, 40))))
    return texts


EXAMPLES = {
    "SQL_INJECTION": 'st.executeQuery("SELECT a FROM b WHERE c=" + d);', "HARDCODED_SECRET": 'String dbPasswordOld = "abcd";',
    "WEAK_CRYPTOGRAPHY": 'MessageDigest.getInstance("MD5")', "COMMAND_INJECTION": 'Runtime.getRuntime().exec("ls " + a)',
    "PATH_TRAVERSAL": 'new File("/up/" + a)', "EMPTY_CATCH_BLOCK": "try { a(); } catch (E e) { }", "RESOURCE_LEAK": "new Socket(a, 1)",
    "STRING_CONCAT_IN_LOOP": 'for (String s : xs) { out += s + ","; }', "NULL_POINTER_RISK": 'q.getParameter("k").trim()',
}


def mutated(seed: int, n: int) -> list[str]:
    pick = random.Random(seed)
    texts = []
    for _ in range(n):
        text = "".join(pick.choice(list(EXAMPLES.values())) for _ in range(pick.randint(1, 3)))
        for _ in range(pick.randint(0, 6)):
            at = pick.randrange(len(text) + 1)
            text = text[:at] + pick.choice(["", *PIECES]) + text[at + pick.choice([0, 0, 1, 3]) :]
        texts.append(text)
    return texts


def test_signatures_equal_their_plain_patterns(spark):
    texts = [*EXAMPLES.values(), *random_texts(1, 20_000), *mutated(2, 20_000), "", "é" * 5]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)
    names = [name for name, *_ in K.SIGNATURES]
    got = rows.select("id", *[matches(F.col("text"), name).alias(name) for name in names]).collect()
    for name, pattern, *_ in K.SIGNATURES:
        plain = re.compile(pattern, re.ASCII)
        expected = {i for i, text in enumerate(texts) if plain.search(text)}
        assert len(expected) > 100, name
        assert {r["id"] for r in got if r[name]} == expected, name


MB = 1 << 20
#: Texts that make a search try again and again: many beginnings, a part that is missing or comes once.
HOSTILE = [
    "+ ; ( \" = ) { += for catch new . " + part for part in [
        "execute( select ", "execute(", "execute (insert ", "select execute(", "insert " * 3 + "execute( ", "password", "password= ", 'token = "', "api_key ",
        "MessageDigest.getInstance ( ", "Cipher.getInstance(", "ProcessBuilder( ", "Runtime.getRuntime().exec ( ", "new File( ", "new ", "new\t", "catch( ",
        "catch ( x ", "for ( ", "for(x) { a += ", "for(x) { ", "a += ", "x+=", "for(;;) { a += b } ", "getParameter( ", ".get( ", "getParameter(x) .a", "a", " ", "{", "}", '"',
        "for(x){a+=b;", ")", ";",
    ]
]


@pytest.mark.parametrize("name", [name for name, *_ in K.SIGNATURES])
def test_signatures_are_linear(spark, name):
    head = '+ ; ( " = ) { += for catch new . '
    for text in HOSTILE:
        part = text[len(head) :]
        # the guards' literals stand in front, so that the pattern itself is tried
        rows = spark.createDataFrame([(head + part * (MB // len(part)),)], "text string").select(matches(F.col("text"), name).alias("found"))
        rows.schema
        began = time.time()
        rows.collect()
        assert time.time() - began < 2.5, (name, part)
