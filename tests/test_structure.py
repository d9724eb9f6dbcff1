"""Structural rules on small sources: one detection or non-detection per case."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators.lexer import token_table
from riskweave.operators.rules import static_findings
from riskweave.operators.structure import code_sites, method_snippets, structure_quarantine


def in_method(body: str, header: str = "void m(String a, List<String> xs, int n) throws Exception") -> str:
    return "class A {\n    " + header + " {\n" + body + "\n    }\n}\n"


# (source, expected (line, type) pairs)
CASES = [
    (in_method('st.executeQuery("SELECT a FROM b WHERE c=\'" + a + "\'");'), [(3, "SQL_INJECTION")]),
    (in_method('st.executeQuery("SELECT a FROM b WHERE c = ?");'), []),
    (in_method('String q = "select " + a; st.execute(q);'), [(3, "SQL_INJECTION")]),
    (in_method('int i = 1, j = 2; String p = "x", q = "delete from t where k=" + a;'), [(3, "SQL_INJECTION")]),
    (in_method('q = "delete from t where k=" + a;'), []),
    (in_method('st.execute(("select " + a));'), []),
    (in_method('st.execute(n > 1 ? "select " + a : a);'), []),
    (in_method('st.execute(new HashMap<String, List<String>>(), "update t " + a);'), [(3, "SQL_INJECTION")]),
    (in_method('st\n  .execute("update t set a=" + a);'), [(3, "SQL_INJECTION")]),
    (in_method('st.execute("update t" // why\n + a);'), []),
    (in_method('String dbPassword = "secret123";'), [(3, "HARDCODED_SECRET")]),
    (in_method('String dbPassword = "changeme", apiKey = "abcd1234";'), [(3, "HARDCODED_SECRET")]),
    (in_method('String dbPassword = System.getenv("DB_PASSWORD");'), []),
    (in_method('dbPassword = "secret123"; this.token = "abcdef";'), []),
    ('class A { @Conf(password = "abcdef") String greeting = "hello world"; }', []),
    ('class A { String token = """\n  abcdef"""; }', []),
    (in_method('MessageDigest.getInstance("md5"); MessageDigest.getInstance("SHA-256"); X.getInstance("MD5");'),
     [(3, "WEAK_CRYPTOGRAPHY")]),
    (in_method('Runtime.getRuntime().exec("ls " + a); r.exec("ls", a); r.exec("ls " + a - b);'), [(3, "COMMAND_INJECTION")]),
    (in_method('new ProcessBuilder("x " + a); ProcessBuilder("x " + a);'), [(3, "COMMAND_INJECTION")]),
    (in_method('File f = new java.io.File("/up/" + a); File g = new File(a, b + c);'),
     [(3, "PATH_TRAVERSAL"), (3, "PATH_TRAVERSAL")]),
    (in_method("try { r(); } catch (Exception e) {}"), [(3, "EMPTY_CATCH_BLOCK")]),
    (in_method("try { r(); } catch (Exception e) { ; } catch (final A | B e) { // nothing\n }"), [(3, "EMPTY_CATCH_BLOCK")]),
    (in_method('for (String s : xs) { out += ", "; }'), [(3, "STRING_CONCAT_IN_LOOP")]),
    (in_method("for (int v : vs) { sum += v; }"), []),
    (in_method('for (int i = 0; i < n; i++) if (n > i) out += "x"; else out += "y"; out += "z";'),
     [(3, "STRING_CONCAT_IN_LOOP")] * 2),
    (in_method('if (n > 0) for (String s : xs) out += "x"; else out += "y";'), [(3, "STRING_CONCAT_IN_LOOP")]),
    (in_method('for (String s : xs) if (n > 0) if (n > 1) out += "x"; else out += "y"; else out += "z"; out += "u";'),
     [(3, "STRING_CONCAT_IN_LOOP")] * 3),
    (in_method('st.execute("select " + String.join(",", new String[]{a, "b"}));'), [(3, "SQL_INJECTION")]),
    (in_method('st.execute("select " + f(new int[][]{{1}, {2}}));'), [(3, "SQL_INJECTION")]),
    (in_method('st.execute("select " + f(x -> { return 1; }));'), []),
    (in_method('do { out += "x"; } while (n > 0);'), []),
    (in_method('while (n > 0) { xs.forEach(x -> { out += "x"; }); }'), [(3, "STRING_CONCAT_IN_LOOP")]),
    (in_method("Socket s = new Socket(a, 1);"), [(3, "RESOURCE_LEAK")]),
    (in_method("try (BufferedReader r = new BufferedReader(new FileReader(a))) { r.readLine(); }"), []),
    (in_method("try (Socket s = open()) { x(); } catch (E e) { y(new Socket(a, 1), new FileReader(a)); }"),
     [(3, "RESOURCE_LEAK")]),
    (in_method("try (Socket s = open()) { try { y(new Socket(a, 1)); } finally { z(); } }"), [(3, "RESOURCE_LEAK")]),
    (in_method("return n + 1;", "int m(int n)"), []),
]


def findings(spark, sources: list[str]) -> dict[int, list[tuple[int, str]]]:
    files = spark.createDataFrame(list(enumerate(sources)), "file_id bigint, src string")
    rows = static_findings(code_sites(files)).select("file_id", "line_number", "vulnerability_type").collect()
    found: dict[int, list[tuple[int, str]]] = {i: [] for i in range(len(sources))}
    for row in rows:
        found[row.file_id].append((row.line_number, row.vulnerability_type))
    return found


def test_every_case(spark):
    found = findings(spark, [source for source, _ in CASES])
    wrong = {CASES[i][0]: (sorted(found[i]), expected) for i, (_, expected) in enumerate(CASES)
             if sorted(found[i]) != sorted(expected)}
    assert not wrong


def test_methods_constructors_records(spark):
    source = """
class Outer {
    @Inject Outer(String a) { x(); }
    <T> List<T> one(List<Map<String, T>> in) { return null; }
    public int[] two() throws A, B {
        return new Runner() { public void run() { go(); } }.result();
    }
    abstract void none();
    record Point(int x, int y) { int sum() { return x + y; } }
    interface Inner { default String three() { return "}"; } }
}
enum Colour { RED("r") { void four() { } }; Colour(String s) { } }
"""
    files = spark.createDataFrame([(1, source)], "file_id bigint, src string")
    rows = method_snippets(code_sites(files)).orderBy("method_seq").collect()
    assert [(r.class_name, r.method_name, r.start_line, r.end_line) for r in rows] == [
        ("Outer", "one", 4, 4), ("Outer", "run", 6, 6), ("Outer", "two", 5, 7), ("Outer", "sum", 9, 9),
        ("Inner", "three", 10, 10), ("UnknownClass", "four", 12, 12)]
    assert rows[1].code == "public void run() { go(); }"


def test_methods_behind_any_type_arguments(spark):
    deep = "List<" * 9 + "String" + ">" * 9
    sources = {
        f"{deep} a() {{ }}": "a", "List<@NonNull String> b() { }": "b", "int c()[] { return null; }": "c",
        "<T extends Number & Comparable<T>> T d(Map<? super T, int[]> m) { }": "d",
        "Map<String, Map<String, Map<String, List<String>>>> e() { }": "e",
        "List<" * 200 + "String" + ">" * 200 + " f() { }": "f",
        "List<@Size(max = 3) String> g(Map<@Pattern(regexp = \"a>b\") String, @A @b.C({1, 2}) int[]> m) { }": "g",
        "Map<Outer<A>.Inner<B>, ? super @Q(@R(@S(1))) C<?>> h() { }": "h",
        "<T extends Comparable<? super T> & Map<A, B>, U> void i(List</* c */ T\n> a, Set<U>... b) { }": "i",
        "java.util.List<java.lang.String[][]> j() { return new ArrayList<>(); }": "j",
    }
    files = spark.createDataFrame([(i, "class A {\n" + s + "\n}") for i, s in enumerate(sources)], "file_id bigint, src string")
    rows = method_snippets(code_sites(files)).orderBy("file_id").collect()
    assert [(r.method_name, r.code) for r in rows] == [(name, source) for source, name in sources.items()]


def test_comparisons_are_no_type_arguments(spark):
    source = in_method('boolean b = n < 3 & n > 1; if (a < b && c > d) { for (String s : xs) { out += "x"; } }')
    assert findings(spark, [source])[0] == [(3, "STRING_CONCAT_IN_LOOP")]


@pytest.mark.parametrize("expression", [
    "a < b", "a < b && c > d", "a < b & c > d", "a < b ? c > d : e", "f(a < b, c > 3)", "a < 3 > b", "a[1] < b && x[c > d ? 1 : 2]", "a < this.b | c > d",
    "a < (b) && (c) > d", "a < -b && c > d", "a < b + c && d > e", "a < f(b) || c > d", "a < b.c == d > e",
])
def test_operators_of_comparisons_stay_operators(spark, expression):
    source = in_method(f"boolean v = {expression}; List<String> w = null;")
    kinds = [(r.tok, r.kind) for r in token_table(spark.createDataFrame([(1, source)], "file_id bigint, src string")).orderBy("pos").collect()]
    written = [t for t, k in kinds if k == "generic"]
    assert written == ["<", "String", ">"] * 2  # the parameter's and the last declaration's
    assert "".join(t for t, _ in kinds) == source


def test_type_arguments_without_end_stay_linear(spark):
    sources = ["class A { x " + "<" * 100_000 + " }", "class A { x " + "A<" * 100_000 + "B" + ">" * 100_000 + " m() { } }", "class A { " + "a < b, " * 50_000 + "}"]
    files = spark.createDataFrame(list(enumerate(sources)), "file_id bigint, src string")
    assert [(r.file_id, r.method_name) for r in method_snippets(code_sites(files)).collect()] == [(1, "m")]


def test_comment_of_a_method_belongs_to_its_snippet(spark):
    source = 'class A {\n /* other */ int x;\n // a\n /** key = "abcd" */\n <T> void m(String a) { st.execute("select " + a); }\n}'
    files = spark.createDataFrame([(1, source)], "file_id bigint, src string")
    row = method_snippets(code_sites(files)).first()
    assert row.code.startswith('/** key = "abcd" */\n <T> void m') and row.hint is None and row.start_line == 5


@pytest.mark.parametrize("source, line, reason", [
    ("class A {\n void a( {\n }\n}", 4, "BRACKET_MISMATCH"),
    ("class A {\n}\n}", 3, "BRACKET_MISMATCH"),
    ("class A {\n void a() { }", 2, "BRACKET_NOT_CLOSED"),
    ('class A {\n String s = "abc;\n}', 2, "UNTERMINATED_LITERAL"),
    ("class A { }\n/* open", 2, "UNTERMINATED_COMMENT"),
])
def test_broken_structure(spark, source, line, reason):
    files = spark.createDataFrame([(1, source), (2, "class B { }")], "file_id bigint, src string")
    rows = [(r.file_id, r.line, r.reason) for r in structure_quarantine(files).collect()]
    assert rows == [(1, line, reason)]
    assert [r.file_id for r in code_sites(files).where("kind = 'eof'").collect()] == [2]


def test_tokens_join_back_to_the_text(spark):
    pieces = ['"a\\"b"', "'\\''", "/* x */", "// y\n", '"""\n t "q" \\""" u"""', "name", "0x1F", "1e-3", ">>=", "->",
              "List<Map<String, ?>>", " ", "\n", "é", "\U0001f600", "{", "}", '"', "\\", "a < b"]
    pick = random.Random(7)
    sources = ["".join(pick.choice(pieces) for _ in range(60)) for _ in range(200)]
    sources.append('"' + "\\n" * 100_000 + '"')
    files = spark.createDataFrame(list(enumerate(sources)), "file_id bigint, src string")
    joined = token_table(files).groupBy("file_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), "").alias("j"))
    assert joined.join(files, "file_id").where("j != src").count() == 0
    assert joined.count() == len(sources)


def test_plan_has_one_exchange_and_no_python(spark):
    files = spark.createDataFrame([(1, "class A { }")], "file_id bigint, src string")
    df = code_sites(files)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("- Exchange hashpartitioning") == 1 and "ReusedExchange" in plan
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_parts_go_by_the_size_of_the_texts(spark, monkeypatch):
    from riskweave.operators import lexer
    files = spark.createDataFrame([(i, f"class A{i} {{ void m() {{ }} }}" + " " * 1000) for i in range(200)] + [(None, "x"), (500, None)],
                                  "file_id bigint, src string")
    assert lexer.parts_for(files) == spark.sparkContext.defaultParallelism == lexer.parts_for(files.limit(0))
    monkeypatch.setattr(lexer, "TASK_BYTES", 5_000)
    assert lexer.parts_for(files) > 200 * 1000 // 5_000
    assert lexer.spread_files(files).rdd.getNumPartitions() == lexer.parts_for(files.where("file_id is not null"))


def test_stored_places_change_nothing(spark):
    files = spark.createDataFrame(list(enumerate(["class A { void m(Statement s, String x) { s.execute(\"select \" + x); } }", "class B { (", None])),
                                  "file_id bigint, src string")
    assert sorted(map(str, code_sites(files, apart=True).collect())) == sorted(map(str, code_sites(files).collect()))


def test_texts_meet_stored_places_where_they_lie(spark):
    from riskweave.operators.structure import all_sites
    files = spark.createDataFrame([(i, f"class A{i} {{ void m() {{ }} }}") for i in range(50)], "file_id bigint, src string")
    kept, partitions = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", 64)  # more than the files are dealt into
    try:
        plan = all_sites(files, apart=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    # one exchange for the texts and one for the places; none moves the encoded texts again
    assert plan.count("- Exchange hashpartitioning") == 2 and "ENSURE_REQUIREMENTS" not in plan and "SortMergeJoin" in plan


def test_blanks_have_no_rows_of_their_own(spark):
    from itertools import accumulate

    from riskweave.operators import lexer, structure
    sources = [
        "  class A {\r\n\tint a = 1 ; // x  \r  /* y\n */ \f String s = \"p \\\" q\" + 'c' ;\n}\n", " \n", "", None, "/**/ /*/ ", "a \u000b b\u00a0 \x00 c '\n' \" \n x",
        'x = """\n two\n""" \n; f( a , ( b) ) /* open \n ', "\U0001f600 /*\U0001f600*/ \U0001f600 \r\n[é ]",
    ]
    files = spark.createDataFrame(list(enumerate(sources)), "file_id bigint, src string")
    old, new, placed = {}, {}, {}
    for r in sorted(lexer.cut(files).select("*", lexer.line_breaks(F.col("tok"), F.col("kind")).alias("breaks")).collect()):
        old.setdefault(r.file_id, []).append(r)
    for r in sorted(lexer.cut_with_blanks(files).collect()):
        new.setdefault(r.file_id, []).append(r)
    for r in structure._level_rows(files).where(f"k not in ({structure.BEGIN}, {structure.END})").collect():
        placed.setdefault(r.file_id, set()).add((r.place, None if r.k == structure.BAD else r.c1))
    for i, source in enumerate(sources):
        assert "".join(r.piece for r in new[i]) == (source or "")
        assert [(r.kind, r.tok.rstrip(lexer.BLANKS)) for r in old[i] if r.kind != "space"] == [(r.kind, r.tok) for r in new[i] if r.kind != "space"]
        assert all(n == 0 for n, r in enumerate(new[i]) if r.kind == "space")
        ends, lines = list(accumulate(len(r.tok) for r in old[i])), list(accumulate(r.breaks for r in old[i]))
        wanted = {(((end - len(r.tok) + 1) << 31) + 1 + line - r.breaks, None if r.kind == "bad" else end)
                  for r, end, line in zip(old[i], ends, lines, strict=True) if r.kind not in ("space", "comment")}
        assert placed[i] == wanted


def test_pieces_are_cut_without_counting_through_the_text(spark):
    head = "\ufeff/* \U0001f600 é " + "x" * 5_000 + " */"
    body = 'class Ä { /* \U0001f600 */ void m(Statement s, String x) { String p = "\U0001f600k"; s.execute("select é" + x); } }'
    files = spark.createDataFrame([(1, head + body), (2, "\ufeffint m(int a) { }"), (3, None)], "file_id bigint, src string")
    sites = code_sites(files).where("kind in ('method', 'call', 'init')")
    got = {(r.file_id, r.kind): (r.name, r.code, r.class_name, r.value) for r in sites.collect()}
    assert got == {
        (1, "method"): ("m", body[8:-2][2:], "Ä", None), (1, "init"): ("p", 'p = "\U0001f600k"', "Ä", "\U0001f600k"),
        (1, "call"): ("execute", 's.execute("select é" + x)', "Ä", None), (2, "method"): ("m", "\ufeffint m(int a) { }", None, None)}
    plan = sites._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    encoded = [line for line in plan.splitlines() if "UTF-32" in line and "encode" in line.lower() and "Generate explode" in line]
    assert len(encoded) == 1 and "substring(src" not in "".join(line for line in plan.splitlines() if "Project" in line and "UTF-32" not in line)
