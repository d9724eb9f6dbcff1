"""ANSI SQL that recomputes every query on the same tables, for DuckDB.

Structural operators are checked against tables of expected results per code
template, written down by reading the templates: they share nothing with the
tokenizer.  Text operators are recomputed with the engine's own functions.
"""

from __future__ import annotations

from riskweave.functions import constants as K
from riskweave.functions.texts import RULE_TEXTS
from riskweave.operators.quality import FINDING_LENGTHS, FINDING_REQUIRED, RECORD_LENGTHS, RECORD_REQUIRED
from riskweave.plans.java_corpus import N_TEMPLATES, TEMPLATES, WEAK_METHODS
from riskweave.plans.queries import ODD_SCORE_LINES

# ---------------------------------------------------------------------------
# expected results per template (line numbers are relative to the template)
# ---------------------------------------------------------------------------
FIELD = K.NO_METHOD

# (template, method_seq, name, first line, last line, hint)
METHODS = [
    (0, 1, "area", 2, 4, None),
    (1, 1, "load", 2, 4, None),
    (2, 1, "purge", 2, 5, None), (2, 2, "safe", 6, 10, None),
    (3, 1, "open", 5, 8, "possible_hardcoded_secret"),
    (4, 1, "digest", 2, 7, None),
    (5, 1, "run", 2, 6, None),
    (6, 1, "put", 2, 5, None),
    (7, 1, "go", 2, 6, "possible_swallowed_exception"),
    (8, 1, "join", 2, 15, None),
    (9, 1, "first", 2, 6, None),
    (10, 1, "peek", 2, 5, None),
    (11, 1, "pick", 2, 5, None),
    (12, 1, "mix", 2, 5, "possible_hardcoded_secret"),
    (13, 1, "run", 4, 6, None), (13, 2, "outer", 2, 8, None),
    (16, 1, "deep", 2, 4, None), (16, 2, "noted", 5, 7, None), (16, 3, "cells", 8, 10, None),
    (16, 4, "sized", 11, 13, None), (16, 5, "piled", 14, 16, None),
    (17, 1, "list", 2, 5, None),
    (18, 1, "tail", 2, 6, None),
    (19, 1, "m", 2, 2, None),
    (20, 1, "help", 3, 5, "possible_hardcoded_secret"),
    *[(21, i + 1, f"p{i}", 2 + 3 * i, 4 + 3 * i, None) for i in range(WEAK_METHODS)],
    (22, 1, "pick", 2, 4, None), (22, 2, "each", 5, 10, None),
]
# (template, method_seq): the code of these methods begins with a comment, one line before the method
COMMENTED = [(20, 1)]

# (template, list_seq, rule, line, method, code, {name}, {detail}, {param}, {env})
RULE_HITS = [
    (1, 1, "rule_sql_inline", 3, "load",
     """st.executeQuery("SELECT id FROM people WHERE nick='" + who + "'")""", "executeQuery", "", "", ""),
    (2, 1, "rule_sql_variable", 3, "purge", 'text = "DELETE FROM items_@ID@ WHERE k=" + key', "text", "", "", ""),
    (3, 1, "rule_hardcoded_secret", 2, FIELD, 'apiKey = "k-@ID@-live"', "apiKey", "", "", "API_KEY"),
    (4, 1, "rule_weak_crypto", 3, "digest", 'MessageDigest.getInstance("sha-1")', "getInstance", "sha-1", "", ""),
    (4, 2, "rule_weak_crypto", 4, "digest", 'Cipher.getInstance("DESede/CBC/PKCS5Padding")', "getInstance",
     "DESede/CBC/PKCS5Padding", "", ""),
    (5, 1, "rule_command_exec", 3, "run", 'Runtime.getRuntime().exec("tool " + a)', "exec", "", "", ""),
    (5, 2, "rule_command_builder", 4, "run", 'new ProcessBuilder("tool2 " + a)', "ProcessBuilder", "", "", ""),
    (6, 1, "rule_path_traversal", 3, "put", 'new FileWriter("/data/" + n)', "FileWriter", "", "", ""),
    (6, 2, "rule_resource_leak", 3, "put", 'new FileWriter("/data/" + n)', "FileWriter", "", "", ""),
    (7, 1, "rule_empty_catch", 3, "go", "catch (IOException e) { }", "", "IOException", "e", ""),
    (7, 2, "rule_empty_catch", 4, "go", "catch (RuntimeException e) { /* ignored */ }", "", "RuntimeException", "e", ""),
    (8, 1, "rule_concat_in_loop", 6, "join", 'out += x + ";"', "", "", "", ""),
    (8, 2, "rule_concat_in_loop", 10, "join", 'out += "-"', "", "", "", ""),
    (10, 1, "rule_resource_leak", 3, "peek", "new Socket(p, 80)", "Socket", "", "", ""),
    (12, 1, "rule_hardcoded_secret", 3, "mix", 'apiKey = "abc123xyz"', "apiKey", "", "", "API_KEY"),
    (12, 2, "rule_command_exec", 4, "mix", 'Runtime.getRuntime().exec("ls " + who)', "exec", "", "", ""),
    (14, 1, "rule_sql_inline", 4, FIELD, 'c.createStatement().execute("UPDATE t SET a=" + who)', "execute", "", "", ""),
    (17, 1, "rule_sql_inline", 3, "list", 'st.execute("select " + String.join(",", new String[]{a, "b"}))', "execute", "", "", ""),
    (17, 2, "rule_path_traversal", 4, "list", 'new File("/up/" + a)', "File", "", "", ""),
    (18, 1, "rule_concat_in_loop", 4, "tail", 'out += "x"', "", "", "", ""),
    (19, 1, "rule_sql_inline", 2, "m", 'st.execute("select " + a)', "execute", "", "", ""),
]
RULE_TYPE = {
    "rule_sql_inline": "SQL_INJECTION", "rule_sql_variable": "SQL_INJECTION",
    "rule_hardcoded_secret": "HARDCODED_SECRET", "rule_weak_crypto": "WEAK_CRYPTOGRAPHY",
    "rule_command_exec": "COMMAND_INJECTION", "rule_command_builder": "COMMAND_INJECTION",
    "rule_path_traversal": "PATH_TRAVERSAL", "rule_empty_catch": "EMPTY_CATCH_BLOCK",
    "rule_concat_in_loop": "STRING_CONCAT_IN_LOOP", "rule_resource_leak": "RESOURCE_LEAK",
}

# (template, method_seq, type, confidence); all other methods score NONE
SCORES = [
    (1, 1, "SQL_INJECTION", 0.5), (3, 1, "HARDCODED_SECRET", 0.65), (4, 1, "WEAK_CRYPTOGRAPHY", 0.5),
    (5, 1, "COMMAND_INJECTION", 0.5), (7, 1, "EMPTY_CATCH_BLOCK", 0.5), (8, 1, "STRING_CONCAT_IN_LOOP", 0.5),
    (9, 1, "RESOURCE_LEAK", 0.5), (10, 1, "RESOURCE_LEAK", 0.5), (11, 1, "NULL_POINTER_RISK", 0.5),
    (12, 1, "COMMAND_INJECTION", 0.5), (13, 1, "NULL_POINTER_RISK", 0.5), (13, 2, "NULL_POINTER_RISK", 0.5),
    (17, 1, "SQL_INJECTION", 0.5), (19, 1, "SQL_INJECTION", 0.5), (20, 1, "HARDCODED_SECRET", 0.65),
    *[(21, i + 1, "NULL_POINTER_RISK", 0.5) for i in range(WEAK_METHODS)], (22, 1, "NULL_POINTER_RISK", 0.5),
]

# (template, display_seq, line, type, method, source, confidence)
FINAL = [
    (1, 1, 3, "SQL_INJECTION", "load", "STATIC+AI", 0.9),
    (2, 1, 3, "SQL_INJECTION", "purge", "STATIC", 0.9),
    (3, 1, 2, "HARDCODED_SECRET", FIELD, "STATIC", 0.85), (3, 2, 5, "HARDCODED_SECRET", "open", "AI", 0.65),
    (4, 1, 3, "WEAK_CRYPTOGRAPHY", "digest", "STATIC+AI", 0.88), (4, 2, 4, "WEAK_CRYPTOGRAPHY", "digest", "STATIC", 0.88),
    (5, 1, 3, "COMMAND_INJECTION", "run", "STATIC+AI", 0.9), (5, 2, 4, "COMMAND_INJECTION", "run", "STATIC", 0.9),
    (6, 1, 3, "PATH_TRAVERSAL", "put", "STATIC", 0.75), (6, 2, 3, "RESOURCE_LEAK", "put", "STATIC", 0.7),
    (7, 1, 3, "EMPTY_CATCH_BLOCK", "go", "STATIC+AI", 0.95), (7, 2, 4, "EMPTY_CATCH_BLOCK", "go", "STATIC", 0.95),
    (8, 1, 6, "STRING_CONCAT_IN_LOOP", "join", "STATIC+AI", 0.8), (8, 2, 10, "STRING_CONCAT_IN_LOOP", "join", "STATIC", 0.8),
    (9, 1, 2, "RESOURCE_LEAK", "first", "AI", 0.5),
    (10, 1, 3, "RESOURCE_LEAK", "peek", "STATIC+AI", 0.7),
    (11, 1, 2, "NULL_POINTER_RISK", "pick", "AI", 0.5),
    (12, 1, 4, "COMMAND_INJECTION", "mix", "STATIC+AI", 0.9), (12, 2, 3, "HARDCODED_SECRET", "mix", "STATIC", 0.85),
    (13, 1, 4, "NULL_POINTER_RISK", "run", "STATIC+AI", 0.5),
    (14, 1, 4, "SQL_INJECTION", FIELD, "STATIC", 0.9),
    (17, 1, 3, "SQL_INJECTION", "list", "STATIC+AI", 0.9), (17, 2, 4, "PATH_TRAVERSAL", "list", "STATIC", 0.75),
    (18, 1, 4, "STRING_CONCAT_IN_LOOP", "tail", "STATIC", 0.8),
    (19, 1, 2, "SQL_INJECTION", "m", "STATIC+AI", 0.9),
    (20, 1, 3, "HARDCODED_SECRET", "help", "AI", 0.65),
    *[(21, i + 1, 2 + 3 * i, "NULL_POINTER_RISK", f"p{i}", "AI", 0.5) for i in range(WEAK_METHODS)],
    (22, 1, 2, "NULL_POINTER_RISK", "pick", "AI", 0.5),
]

# (template, kind, line, name, method); the places at which findings are looked for
PLACES = [
    (1, "call", 3, "executeQuery", "load"),
    (2, "init", 3, "text", "purge"), (2, "call", 4, "executeUpdate", "purge"), (2, "call", 9, "executeQuery", "safe"),
    (3, "init", 2, "apiKey", FIELD), (3, "init", 3, "dbPassword", FIELD), (3, "init", 6, "vaultSecret", "open"),
    (3, "init", 7, "note", "open"),
    (4, "call", 3, "getInstance", "digest"), (4, "call", 4, "getInstance", "digest"), (4, "call", 5, "getInstance", "digest"),
    (5, "call", 3, "exec", "run"), (5, "call", 4, "ProcessBuilder", "run"), (5, "call", 5, "ProcessBuilder", "run"),
    (6, "call", 3, "FileWriter", "put"), (6, "call", 4, "File", "put"),
    (7, "catch", 3, None, "go"), (7, "catch", 4, None, "go"),
    (8, "init", 3, "out", "join"), (8, "append", 6, None, "join"), (8, "append", 10, None, "join"),
    (8, "append", 13, None, "join"),
    (9, "call", 3, "BufferedReader", "first"), (9, "call", 3, "FileReader", "first"),
    (10, "call", 3, "Socket", "peek"),
    (12, "init", 3, "apiKey", "mix"), (12, "call", 4, "exec", "mix"),
    (14, "call", 4, "execute", FIELD),
    (17, "call", 3, "execute", "list"), (17, "call", 4, "File", "list"),
    (18, "init", 3, "out", "tail"), (18, "append", 4, None, "tail"), (18, "append", 4, None, "tail"),
    (19, "call", 2, "execute", "m"),
]
# (line of ODD_SCORE_LINES, field, reason)
ODD_REASONS = [
    (2, "file_id", "MISSING"),
    (3, "method_seq", "WRONG_TYPE"), (3, "vulnerability_type", "WRONG_TYPE"), (3, "severity_score", "WRONG_TYPE"), (3, "issue_description", "WRONG_TYPE"),
    (4, "severity_score", "TOO_LARGE"), (4, "confidence", "TOO_SMALL"),
    (5, "vulnerability_type", "NULL"), (5, "severity_score", "TOO_SMALL"), (5, "confidence", "NULL"), (5, "model_version", "NULL"),
    (6, "file_id", "WRONG_TYPE"), (6, "method_seq", "NULL"),
    (7, None, "NOT_JSON"), (8, None, "NOT_JSON"), (9, None, "NOT_JSON"), (10, None, "NOT_JSON"),
    *[(12, field, "MISSING") for field in ("file_id", "method_seq", "vulnerability_type", "severity_score", "issue_description")],
]
# templates in which some method is scored and no structural finding agrees
ONLY_SCORED = "(3, 9, 11, 13, 20, 21, 22)"


# ---------------------------------------------------------------------------
# SQL pieces
# ---------------------------------------------------------------------------

def lit(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool) or not isinstance(value, str):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, row)) + ")" for row in rows) + ")"


CODE = f"""
templates AS (SELECT * FROM {values(list(enumerate(TEMPLATES)))} v(t, template)),
code AS (
  SELECT doc_id AS file_id, 'C' || doc_id || '.java' AS file_name, t,
         '/* ' || replace(text, '*/', '') || ' */' || chr(10) || replace(template, '@ID@', CAST(doc_id AS VARCHAR)) AS src,
         replace(template, '@ID@', CAST(doc_id AS VARCHAR)) AS body,
         CAST(1 + length(replace(text, '*/', ''))
              - length(replace(replace(text, '*/', ''), chr(10), '')) AS INTEGER) AS shift
  FROM documents JOIN templates ON t = doc_id % {N_TEMPLATES})"""

CATALOG = f"""
catalog AS (SELECT v.*, CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 6 WHEN 'MEDIUM' THEN 3 ELSE 1 END AS weight
  FROM {values(K.CATALOG)}
  v(vulnerability_type, display_name, severity, category, owasp_category, rule_confidence))"""

METHOD_ROWS = f"""
methods AS (
  SELECT file_id, CAST(seq AS INTEGER) AS method_seq, 'C' || file_id AS class_name, name AS method_name,
         ltrim(array_to_string(list_slice(string_split(body, chr(10)), CASE WHEN (t, seq) IN ({", ".join(map(str, COMMENTED))}) THEN s - 1 ELSE s END, e),
           chr(10))) AS code,
         CAST(s + shift AS INTEGER) AS start_line, CAST(e + shift AS INTEGER) AS end_line, hint
  FROM code JOIN {values(METHODS)} m(t, seq, name, s, e, hint) USING (t))"""

HIT_ROWS = f"""
hits AS (
  SELECT file_id, CAST(seq AS INTEGER) AS list_seq, rule, kind AS vulnerability_type,
         CAST(l + shift AS INTEGER) AS line, m AS method_name, 'C' || file_id AS class_name,
         replace(snippet, '@ID@', CAST(file_id AS VARCHAR)) AS code_snippet, slot_name, slot_detail, slot_param, slot_env
  FROM code JOIN {values([(*h[:3], RULE_TYPE[h[2]], *h[3:]) for h in RULE_HITS])}
  h(t, seq, rule, kind, l, m, snippet, slot_name, slot_detail, slot_param, slot_env) USING (t))"""

FINAL_ROWS = f"""
final AS (
  SELECT file_id, file_name, CAST(seq AS INTEGER) AS display_seq, CAST(l + shift AS INTEGER) AS line_number,
         f.kind AS vulnerability_type, m AS method_name, src_kind AS detection_source,
         CAST(conf AS DOUBLE) AS confidence, severity, weight, category
  FROM code JOIN {values(FINAL)} f(t, seq, l, kind, m, src_kind, conf) USING (t)
  JOIN catalog ON catalog.vulnerability_type = f.kind)"""

SCORE_ROWS = f"""
scores AS (
  SELECT file_id, CAST(seq AS INTEGER) AS method_seq, kind, CAST(conf AS DOUBLE) AS conf
  FROM code JOIN {values(SCORES)} s(t, seq, kind, conf) USING (t))"""

SIGNATURE_TABLE = values([(i, n, s, o) for i, (n, _, s, o) in enumerate(K.SIGNATURES, 1)])

RUNS = """
runs AS (
  SELECT event_id AS record_id, 'U' || user_id || '.java' AS file_name,
         CAST(floor(value) AS INTEGER) % 7 AS total_findings, CAST(floor(value) AS INTEGER) % 3 AS critical_count,
         least(CAST(floor(value) AS INTEGER), 100) AS risk_score,
         CASE event_type WHEN 'error' THEN 'DEGRADED' ELSE 'SUCCESS' END AS ai_engine_status, ts AS analysed_at
  FROM events)"""

TYPED = """
typed AS (
  SELECT event_id, user_id, event_type, value, CASE event_type WHEN 'error' THEN 'sql_injection'
    WHEN 'purchase' THEN 'HARDCODED_SECRET' WHEN 'click' THEN 'Empty_Catch_Block' WHEN 'view' THEN 'SOMETHING_NEW'
    END AS vulnerability_type
  FROM events)"""

LOGGED = """
logged AS (
  SELECT user_id AS file_id, event_id AS method_seq, event_type,
         CASE event_type WHEN 'error' THEN 'NONE' WHEN 'view' THEN 'None' WHEN 'click' THEN ' '
           ELSE 'SQL_INJECTION' END AS vulnerability_type,
         CASE event_type WHEN 'error' THEN 0.0::DOUBLE ELSE round(value / 50, 6) END AS severity_score,
         CASE event_type WHEN 'error' THEN 0.0::DOUBLE ELSE round(value / 1000, 6) END AS confidence,
         CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'signup' THEN 'rule-only' ELSE 'encoder-1' END AS model_version,
         event_type = 'error' AS fallback
  FROM events)"""

TEXTS = """
texts AS (
  SELECT 'document' AS origin, doc_id AS id, CAST(0 AS INTEGER) AS seq, text FROM documents
  UNION ALL SELECT 'method', file_id, method_seq, code FROM methods)"""

GATE_INPUT = """
gate_input AS (
  SELECT CAST(file_id AS VARCHAR) AS file_id, file_name, src FROM code
  UNION ALL SELECT 'p' || page_id, url, html FROM pages)"""

UPLOAD_REASON = """CASE WHEN strlen(src) = 0 THEN 'EMPTY' WHEN file_name IS NULL OR trim(file_name) = '' THEN 'NO_NAME'
    WHEN contains(file_name, '..') OR contains(file_name, '/') OR contains(file_name, chr(92)) THEN 'PATH_CHARS'
    WHEN NOT suffix(lower(file_name), '.java') THEN 'NOT_JAVA' WHEN strlen(src) > 1048576 THEN 'TOO_LARGE' END"""
CONTENT_REASON = """CASE WHEN src IS NULL OR strlen(src) = 0 THEN 'EMPTY'
    WHEN instr(src, chr(0)) > 0 AND strlen(substr(src, 1, instr(src, chr(0)))) <= 1024 THEN 'BINARY'
    WHEN NOT (contains(src, 'class') OR contains(src, 'interface') OR contains(src, 'enum') OR contains(src, 'record'))
    THEN 'NO_TYPE_DECL' END"""

HINT = f"""nullif(concat_ws(',',
    CASE WHEN contains(text, '+') AND NOT regexp_matches(text, '[\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]')
         AND regexp_matches(text, {lit(K.SQL_WORDS)}) THEN 'possible_sql_injection' END,
    CASE WHEN contains(text, '"') AND regexp_matches(text, {lit(K.SECRET_WORDS)}) THEN 'possible_hardcoded_secret' END,
    CASE WHEN contains(text, 'catch') AND contains(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g'), '){{}}')
         THEN 'possible_swallowed_exception' END), '')"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _token_pattern(whole: bool) -> str:
    """Java tokens as far as the corpus has them, written apart from the engine's lexer and for RE2."""
    name = r"[a-zA-Z_$][a-zA-Z0-9_$]*"
    return "|".join([
        r"/\*(?s:.*?)\*/", r"/\*(?s:.*)", r"//[^\n\r]*", r'"""(?s:.*?)"""', r'"(?:[^"\\\n\r]|\\[^\n\r])*"', r"'(?:[^'\\\n\r]|\\[^\n\r])*'",
        name, r"[0-9][0-9_]*\.?[0-9]*", *([_arguments(name)] if whole else []), r"\.\.\.|->|::|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=", r"[ \t\n\r\f]+", r"(?s:.)",
    ])


def _arguments(name: str) -> str:
    """Type arguments, as deep as the corpus has them."""
    arguments = ""
    for _ in range(12):
        unit = rf"(?:@{name}(?:\.{name})*(?:\([^()]*\))? )*(?:\?|{name}(?:\.{name})*" + (f"(?:{arguments})?" if arguments else "") + r"(?:\[\])*)"
        arguments = rf"<(?:{unit}(?: extends | super | & |, |,)?)*>"
    return arguments


def _tokens() -> str:
    kind = """CASE WHEN regexp_matches(tok, '^[\\p{L}_$]') THEN 'word'
      WHEN regexp_matches(tok, '^[ \\t\\r\\n\\f]') THEN 'space'
      WHEN tok LIKE repeat('"', 3) || '%' AND length(tok) >= 6 THEN 'text'
      WHEN tok LIKE '"%' AND length(tok) > 1 THEN 'string' WHEN tok LIKE '''%' AND length(tok) > 1 THEN 'char'
      WHEN regexp_matches(tok, '^\\.?[0-9]') THEN 'number'
      WHEN tok LIKE '//%' OR (tok LIKE '/*%*/' AND length(tok) >= 4) THEN 'comment'
      WHEN tok IN ('"', '''') OR tok LIKE '/*%' THEN 'bad'
      ELSE 'op' END"""
    return f"""
pieces AS (SELECT file_id, unnest(toks) AS piece, generate_subscripts(toks, 1) AS nth
  FROM (SELECT file_id, regexp_extract_all(src, {lit(_token_pattern(True))}) AS toks FROM code)),
parts AS (SELECT file_id, nth, piece LIKE '<%>' AND length(piece) > 1 AS typed,
    CASE WHEN piece LIKE '<%>' THEN regexp_extract_all(piece, {lit(_token_pattern(False))}) ELSE [piece] END AS toks FROM pieces),
cut AS (SELECT file_id, typed, tok, CAST(row_number() OVER (PARTITION BY file_id ORDER BY nth, part) - 1 AS INTEGER) AS pos
  FROM (SELECT file_id, nth, typed, unnest(toks) AS tok, generate_subscripts(toks, 1) AS part FROM parts)),
tokens AS (SELECT file_id, pos, tok, CASE WHEN typed AND NOT regexp_matches(tok, '^[ \\t\\r\\n\\f]') THEN 'generic' ELSE {kind} END AS kind,
  CAST(1 + coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) OVER (
    PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS line
  FROM cut)"""


_GROUPS = """
sig AS (SELECT *, lag(tok) OVER w AS prev_tok, lag(kind) OVER w AS prev_kind,
    CASE WHEN kind = 'op' AND tok IN ('(', '[', '{') THEN 1 WHEN kind = 'op' AND tok IN (')', ']', '}') THEN -1 ELSE 0 END AS step
  FROM tokens WHERE kind NOT IN ('space', 'comment', 'generic') WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
deep AS (SELECT *, sum(step) OVER (PARTITION BY file_id ORDER BY pos) AS d FROM sig),
rows_ AS (
  SELECT *, d AS lvl, false AS child, step = 1 AS opens FROM deep WHERE step = 1
  UNION ALL SELECT *, d + 1, false, false FROM deep WHERE step = -1
  UNION ALL SELECT *, CASE step WHEN 1 THEN d - 1 ELSE d END, true, false FROM deep),
placed AS (SELECT *, last_value(CASE WHEN opens THEN pos END IGNORE NULLS) OVER (
    PARTITION BY file_id, lvl ORDER BY pos, child DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_pos
  FROM rows_)"""


def _scored_text(where: str) -> str:
    return with_(CODE, METHOD_ROWS, TEXTS) + f"SELECT origin, id, seq FROM texts WHERE {where}"


def _rule(rule: str) -> str:
    return with_(CODE, HIT_ROWS) + (
        "SELECT file_id, vulnerability_type, line, method_name, class_name, code_snippet "
        f"FROM hits WHERE rule = '{rule}'")


def _filled(position: int) -> str:
    cases = " ".join(f"WHEN '{rule}' THEN {lit(texts[position])}" for rule, texts in RULE_TEXTS.items())
    return (f"replace(replace(replace(replace(CASE rule {cases} END, '{{name}}', slot_name), '{{detail}}', slot_detail),"
            " '{param}', slot_param), '{env}', slot_env)")


def _violations() -> str:
    record_columns = {"file_name", "ai_engine_status", "risk_score", "engine_version", "analysed_at"}
    finding_columns = {"severity", "category", "detection_source", "confidence", "description"}
    rules = [
        ("record.ai_engine_status.domain", "r", "ai_engine_status NOT IN ('SUCCESS', 'DEGRADED')"),
        ("record.risk_score.range", "r", "NOT risk_score BETWEEN 0 AND 100"),
        ("finding.severity.domain", "f", "severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')"),
        ("finding.category.domain", "f", "category NOT IN ('SECURITY', 'PERFORMANCE', 'LOGIC')"),
        ("finding.detection_source.domain", "f", "detection_source NOT IN ('STATIC', 'AI', 'STATIC+AI')"),
        ("finding.confidence.range", "f", "NOT confidence BETWEEN 0 AND 1"),
    ]
    for table, prefix, columns, required, lengths in (
            ("r", "record", record_columns, RECORD_REQUIRED, RECORD_LENGTHS),
            ("f", "finding", finding_columns, FINDING_REQUIRED, FINDING_LENGTHS)):
        rules += [(f"{prefix}.{c}.required", table, f"{c} IS NULL") for c in required if c in columns]
        rules += [(f"{prefix}.{c}.length", table, f"length({c}) > {n}") for c, n in lengths.items() if c in columns]
    parts = [f"SELECT '{name}' AS rule, count(*) AS n_violations FROM {t} WHERE {cond}" for name, t, cond in rules]
    parts.append("SELECT 'finding.record.foreign_key', count(*) FROM f WHERE record_id NOT IN (SELECT record_id FROM r)")
    return with_("""
r AS (SELECT event_id AS record_id, CASE WHEN event_type <> 'signup' THEN 'U' || user_id END AS file_name,
  upper(event_type) AS ai_engine_status, CAST(floor(value) AS INTEGER) AS risk_score,
  repeat(event_type, 10) AS engine_version, ts AS analysed_at FROM events)""", """
f AS (SELECT event_id + 7 AS record_id, CASE event_type WHEN 'error' THEN 'CRITICAL' ELSE 'low' END AS severity,
  CASE WHEN event_type <> 'view' THEN 'SECURITY' END AS category,
  CASE event_type WHEN 'click' THEN 'STATIC+AI' ELSE 'BOTH' END AS detection_source,
  value / 400 AS confidence, repeat(props, 200) AS description FROM events)""") + " UNION ALL ".join(parts)


_JSON_LINES = """
lines AS (SELECT CASE doc_id % 3
    WHEN 0 THEN '{"fileId":' || doc_id || ',"methodSeq":1,"vulnerabilityType":"SQL_INJECTION","severityScore":' || (doc_id % 13)
      || '.5,"issueDescription":"' || source || '","owaspCategory":null,"extra":{"a":[1,2]},"confidence":0.25}'
    WHEN 1 THEN '{"file_id":' || doc_id || ',"method_seq":2,"vulnerability_type":"NONE","severity_score":' || (doc_id % 13)
      || '.5,"issue_description":"' || lang || '","confidence":' || (doc_id % 3) || '.0,"model_version":"m1"}'
    ELSE '{"fileId":' || doc_id || ',"severityScore":1.0}' END AS value FROM documents
  UNION ALL SELECT props FROM events),
parsed AS (SELECT value,
    CAST(coalesce(value->>'$.fileId', value->>'$.file_id') AS BIGINT) AS file_id,
    CAST(coalesce(value->>'$.methodSeq', value->>'$.method_seq') AS INTEGER) AS method_seq,
    coalesce(value->>'$.vulnerabilityType', value->>'$.vulnerability_type') AS vulnerability_type,
    CAST(coalesce(value->>'$.severityScore', value->>'$.severity_score') AS DOUBLE) AS severity_score,
    coalesce(value->>'$.issueDescription', value->>'$.issue_description') AS issue_description,
    coalesce(value->>'$.suggestedFix', value->>'$.suggested_fix') AS suggested_fix,
    coalesce(value->>'$.owaspCategory', value->>'$.owasp_category') AS owasp_category,
    coalesce(CAST(value->>'$.confidence' AS DOUBLE), 0.0) AS confidence,
    coalesce(value->>'$.modelVersion', value->>'$.model_version', 'unknown') AS model_version FROM lines),
judged AS (SELECT *, coalesce(vulnerability_type IS NOT NULL AND issue_description IS NOT NULL
    AND severity_score BETWEEN 0 AND 10 AND confidence BETWEEN 0 AND 1, false) AS valid FROM parsed)"""

_RECORDS = """
found AS (SELECT file_id, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h,
    count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'LOW') AS l, least(sum(weight), 100) AS risk
  FROM final GROUP BY file_id),
counted AS (SELECT file_id, count(*) AS n_methods FROM methods GROUP BY file_id),
records AS (SELECT code.file_id, file_name, CAST(strlen(src) AS INTEGER) AS file_size_bytes, sha256(src) AS checksum_sha256,
    CAST(coalesce(n, 0) AS INTEGER) AS total_findings, CAST(coalesce(c, 0) AS INTEGER) AS critical_count,
    CAST(coalesce(h, 0) AS INTEGER) AS high_count, CAST(coalesce(m, 0) AS INTEGER) AS medium_count,
    CAST(coalesce(l, 0) AS INTEGER) AS low_count, CAST(coalesce(risk, 0) AS INTEGER) AS risk_score,
    CAST(coalesce(n_methods, 0) AS INTEGER) AS methods_analysed, CAST(coalesce(n_methods, 0) AS INTEGER) AS methods_scored,
    'run-1/' || code.file_id AS record_id, 'run-1' AS run_id, 'SUCCESS' AS ai_engine_status,
    '""" + K.ENGINE_VERSION + """' AS engine_version
  FROM code LEFT JOIN found USING (file_id) LEFT JOIN counted USING (file_id) WHERE t <> 15)"""

_STORED_RECORD = "run_date, run_id, record_id, file_id, file_name, total_findings, risk_score, analysed_at"
_STORED = """
stored AS (SELECT day AS run_date, run AS run_id, run || '/' || file_id AS record_id, file_id, file_name, total_findings, risk_score,
    CAST(day || ' 12:00:00' AS TIMESTAMP) AS analysed_at
  FROM records JOIN (VALUES ('run-10', '2024-01-02', 2, 0), ('run-9', '2024-01-01', 3, 0)) r(run, day, n, rest) ON file_id % n = rest
  UNION ALL SELECT '2024-01-01', 'run-8', 'run-8/' || file_id, file_id, file_name, total_findings, risk_score, TIMESTAMP '2024-01-01 12:00:00'
  FROM records WHERE file_id = 1)"""

_COSINES = """
long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centre AS (SELECT label, i, avg(x) AS m FROM long GROUP BY label, i),
cosines AS (SELECT vec_id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS similarity
  FROM long JOIN centre USING (label, i) GROUP BY vec_id, long.label)"""

# certainty of a scored method: by its vector and the centroid that stands for its type, else neutral; more if the hint agrees
_VECTOR_SCORES = f"""
long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centre AS (SELECT label, i, avg(x) AS m FROM long GROUP BY label, i),
scored_kinds AS (SELECT s.*, k.severity, k.seq - 1 AS anchor FROM scores s JOIN {SIGNATURE_TABLE} k(seq, name, severity, owasp) ON name = kind),
near AS (SELECT file_id, method_seq, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS similarity
  FROM scored_kinds JOIN long ON vec_id = file_id AND method_seq = 1 JOIN centre ON centre.label = anchor AND centre.i = long.i
  GROUP BY file_id, method_seq),
certainties AS (SELECT k.*, round(least(1.0, CASE WHEN similarity IS NULL THEN 0.5 ELSE greatest(0, least(1, (similarity + 1) / 2)) END
    + CASE WHEN conf > 0.5 THEN 0.15 ELSE 0 END), 3) AS certain
  FROM scored_kinds k LEFT JOIN near USING (file_id, method_seq))"""

_PLACE = "file_id, vulnerability_type, line_number, method_name, confidence, detection_source"


def _static_list(extra: str) -> str:
    return with_(CODE, CATALOG, HIT_ROWS) + f"SELECT {extra} FROM hits JOIN catalog USING (vulnerability_type)"


def all_oracles() -> dict[str, str]:
    final = with_(CODE, CATALOG, FINAL_ROWS)
    everything = with_(CODE, CATALOG, METHOD_ROWS, FINAL_ROWS, _RECORDS)
    stored = with_(CODE, CATALOG, METHOD_ROWS, FINAL_ROWS, _RECORDS, _STORED)
    scored = with_(CODE, CATALOG, METHOD_ROWS, SCORE_ROWS)
    patterns = {name: pattern for name, pattern, _, _ in K.SIGNATURES}
    sql = {f"sig_{short}": _scored_text(f"regexp_matches(text, {lit(patterns[kind])})") for short, kind in {
        "sql": "SQL_INJECTION", "secret": "HARDCODED_SECRET", "crypto": "WEAK_CRYPTOGRAPHY",
        "command": "COMMAND_INJECTION", "path": "PATH_TRAVERSAL", "empty_catch": "EMPTY_CATCH_BLOCK",
        "leak": "RESOURCE_LEAK", "concat_loop": "STRING_CONCAT_IN_LOOP", "null_risk": "NULL_POINTER_RISK"}.items()}
    sql |= {rule: _rule(rule) for rule in RULE_TYPE}
    sql |= {
        # scans, gates, sinks
        "scan_corpus": with_(CODE) + """SELECT file_id, file_name, CAST(strlen(src) AS INTEGER) AS size_bytes,
            sha256(src) AS content_sha256 FROM code""",
        "gate_upload": with_(CODE, GATE_INPUT) + f"SELECT file_id, file_name, {UPLOAD_REASON} AS reject_reason FROM gate_input",
        "gate_content": with_(CODE, GATE_INPUT) + f"""SELECT file_id, {CONTENT_REASON} AS reject_reason
            FROM (SELECT file_id, src FROM gate_input UNION ALL SELECT 'd' || doc_id, text FROM documents)""",
        "quarantine_split": with_(CODE, GATE_INPUT) + f"""SELECT coalesce({UPLOAD_REASON}, {CONTENT_REASON}, 'ACCEPTED')
            AS reject_reason, count(*) AS n_files FROM gate_input GROUP BY 1""",
        "sanitise_name": """SELECT origin, id, CASE WHEN length(n) > 120 THEN substr(n, 1, 120) || '...' ELSE n END AS safe_name
            FROM (SELECT origin, id, regexp_replace(v, '[\\r\\n\\t<>]', '', 'g') AS n FROM (
              SELECT 'url' AS origin, page_id AS id, url AS v FROM pages UNION ALL SELECT 'text', doc_id, text FROM documents))""",
        "checksum_size": """SELECT doc_id AS file_id, sha256(text) AS checksum_sha256,
            CAST(strlen(text) AS INTEGER) AS file_size_bytes FROM documents""",
        "reupload_groups": """SELECT sha256(text) AS checksum_sha256, count(*) AS n_copies, min(doc_id) AS first_file
            FROM documents GROUP BY 1""",
        "reupload_dedup": """SELECT doc_id AS file_id, sha256(text) AS checksum_sha256,
            count(*) OVER (PARTITION BY text) AS n_copies, min(doc_id) OVER (PARTITION BY text) AS first_file,
            doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_reupload FROM documents""",
        "structure_quarantine": with_(CODE) + """SELECT file_id, CAST(4 + shift AS INTEGER) AS line,
            'BRACKET_MISMATCH' AS reason FROM code WHERE t = 15""",
        "reupload_across_runs": """WITH sums AS (SELECT doc_id AS file_id, sha256(text) AS checksum_sha256 FROM documents),
            day1 AS (SELECT checksum_sha256, min(file_id) AS f FROM sums WHERE file_id % 2 = 0 GROUP BY 1),
            day2 AS (SELECT *, count(*) OVER w AS n_copies, min(file_id) OVER w AS first_file FROM sums WHERE file_id % 2 = 1
              WINDOW w AS (PARTITION BY checksum_sha256))
            SELECT file_id, checksum_sha256, n_copies, first_file, CAST(f AS VARCHAR) AS seen_file, CASE WHEN f IS NOT NULL THEN '2024-01-01' END AS seen_date,
              CASE WHEN f IS NOT NULL THEN 'run-1' END AS seen_run, file_id <> first_file OR f IS NOT NULL AS is_reupload
            FROM day2 LEFT JOIN day1 USING (checksum_sha256)""",
        "scores_json_in": with_(_JSON_LINES) + "SELECT * EXCLUDE (value, valid) FROM judged WHERE valid",
        "scores_json_rejected": with_(_JSON_LINES) + "SELECT value, count(*) AS n_lines FROM judged WHERE NOT valid GROUP BY value",
        "scores_json_reasons": f"""SELECT value, field, reason, count(*) AS n_lines FROM (
            SELECT replace(line, '@ID@', 'f-' || doc_id) AS value, field, reason FROM documents
            JOIN {values(list(enumerate(ODD_SCORE_LINES)))} l(t, line) ON doc_id % {len(ODD_SCORE_LINES)} = l.t
            JOIN {values(ODD_REASONS)} r(t, field, reason) ON r.t = l.t) GROUP BY ALL""",
        "scores_json_text_ids": f"""SELECT 'f-' || doc_id AS file_id, CAST(1 AS INTEGER) AS method_seq, 'X' AS vulnerability_type,
            CAST(score AS DOUBLE) AS severity_score, 'd' AS issue_description, CAST(NULL AS VARCHAR) AS suggested_fix,
            CAST(NULL AS VARCHAR) AS owasp_category, CAST(sure AS DOUBLE) AS confidence, 'unknown' AS model_version
            FROM documents JOIN (VALUES (0, 1.0, 0.0), (1, 1.5, 0.5), (11, 10.0, 1.0)) v(t, score, sure) ON doc_id % {len(ODD_SCORE_LINES)} = t""",
        "scores_for_scanned_files": with_(CODE, METHOD_ROWS) + f"""SELECT substr(sha256('file:/corpus/' || file_name), 1, 32) AS file_id, method_seq,
            method_name, CASE method_seq WHEN 1 THEN 'RESOURCE_LEAK' ELSE 'NONE' END AS vulnerability_type,
            CAST(CASE method_seq WHEN 1 THEN 5.5 ELSE 0 END AS DOUBLE) AS severity_score,
            CAST(CASE method_seq WHEN 1 THEN 0.75 ELSE 0 END AS DOUBLE) AS confidence, method_seq > 1 AS fallback
            FROM methods JOIN code USING (file_id) WHERE {UPLOAD_REASON} IS NULL""",
        "snippets_json_in": """SELECT conv_id AS file_id, CAST(turn AS INTEGER) AS method_seq, role AS class_name,
            CAST(NULL AS VARCHAR) AS method_name, text AS code_snippet,
            CAST(turn - CASE role WHEN 'user' THEN 1 ELSE 0 END AS INTEGER) AS start_line,
            CAST(NULL AS VARCHAR) AS static_analysis_hint FROM conversations
            WHERE turn % 5 <> 4 AND length(text) > 0 AND turn - CASE role WHEN 'user' THEN 1 ELSE 0 END >= 0""",
        "write_results": everything + """SELECT * EXCLUDE (run) REPLACE (run || '/' || file_id AS record_id, run AS run_id),
            '2024-01-01' AS run_date FROM records, (VALUES ('run-1'), ('run-2')) r(run)""",
        "constraint_check": _violations(),
        # structure
        "token_table": with_(CODE, _tokens()) + "SELECT file_id, pos, tok, line, kind FROM tokens",
        "nesting_groups": with_(CODE, _tokens(), _GROUPS) + """SELECT file_id, open_pos,
            max(CASE WHEN NOT child AND step = -1 THEN pos END) AS close_pos, max(CASE WHEN opens THEN tok END) AS bracket,
            max(CASE WHEN opens THEN line END) AS open_line, max(CASE WHEN NOT child AND step = -1 THEN line END) AS close_line,
            max(CASE WHEN opens AND prev_kind = 'word' THEN prev_tok END) AS callee,
            CAST(count(*) FILTER (child) AS INTEGER) AS n_children,
            coalesce(string_agg(tok, ' ' ORDER BY pos) FILTER (child), '') AS child_text
            FROM placed WHERE open_pos IS NOT NULL AND lvl > 0 GROUP BY file_id, open_pos""",
        "method_snippets": with_(CODE, METHOD_ROWS) + "SELECT * FROM methods",
        "attribute_scope": with_(CODE) + f"""SELECT file_id, kind, CAST(l + shift AS INTEGER) AS line, name,
            m AS method_name, 'C' || file_id AS class_name
            FROM code JOIN {values(PLACES)} p(t, kind, l, name, m) USING (t)""",
        "method_hints": f"""SELECT origin, id, seq, {HINT} AS hint FROM (
            SELECT 'document' AS origin, doc_id AS id, CAST(0 AS BIGINT) AS seq, text FROM documents
            UNION ALL SELECT 'turn', conv_id, turn, text FROM conversations)""",
        "snippet_cap": """SELECT conv_id, turn, CAST(r AS INTEGER) AS snippet_rank, substr(text, 1, 200) AS text FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 4""",
        "snippet_cap_code": with_(CODE, METHOD_ROWS) + """SELECT file_id, method_seq, method_seq AS snippet_rank, code
            FROM methods WHERE method_seq <= 25""",
        # rules
        "static_findings": _static_list("""file_id, list_seq, vulnerability_type, display_name, severity, category,
            owasp_category, method_name, class_name, line AS line_number, code_snippet,
            CAST(rule_confidence AS DOUBLE) AS confidence, 'STATIC' AS detection_source"""),
        "finding_texts": with_(CODE, HIT_ROWS) + f"""SELECT file_id, rule, line, {_filled(0)} AS description,
            {_filled(1)} AS remediation FROM hits""",
        "env_name": """SELECT event_id, name, upper(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS env_name
            FROM (SELECT event_id, event_type || 'Db' || user_id || 'ApiKeyX' AS name FROM events)""",
        # signatures
        "signature_scan": with_(CODE, METHOD_ROWS, TEXTS) + " UNION ALL ".join(
            f"""SELECT origin, id, seq, {i} AS sig_seq, '{name}' AS vulnerability_type, CAST({severity} AS DOUBLE) AS severity
            FROM texts WHERE regexp_matches(text, {lit(pattern)})"""
            for i, (name, pattern, severity, _) in enumerate(K.SIGNATURES, 1)),
        "signature_stats": "SELECT source, lang, count(*) AS n_texts, " + ", ".join(
            f"CAST(count(*) FILTER (regexp_matches(text, {lit(pattern)})) AS BIGINT) AS {name.lower()}"
            for name, pattern in patterns.items()) + " FROM documents GROUP BY source, lang",
        # scoring
        "mean_pool": """SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(x), 6) AS mean FROM (
            SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
            GROUP BY label, i""",
        "anchor_similarity": with_(_COSINES) + "SELECT vec_id, round(similarity, 6) AS similarity FROM cosines",
        "confidence_map": with_(_COSINES) + """SELECT vec_id,
            round(CASE WHEN similarity IS NULL THEN 0.5 ELSE greatest(0, least(1, (similarity + 1) / 2)) END, 6) AS confidence
            FROM cosines""",
        "hint_bonus": with_(TYPED) + """SELECT event_id, hint, round(CASE WHEN
              (hint = 'possible_sql_injection,possible_swallowed_exception' AND vulnerability_type = 'sql_injection')
              OR (hint = 'Possible_Hardcoded_Secret' AND vulnerability_type = 'HARDCODED_SECRET')
              THEN least(1.0, c + 0.15) ELSE c END, 6) AS confidence
            FROM (SELECT event_id, vulnerability_type, round(value / 500, 6) AS c, CASE user_id % 4
              WHEN 0 THEN 'possible_sql_injection,possible_swallowed_exception' WHEN 1 THEN 'Possible_Hardcoded_Secret'
              WHEN 2 THEN 'possible_swallowed_exception' END AS hint FROM typed)""",
        "best_match": f"""SELECT file_id, method_seq, vulnerability_type, severity_score, confidence FROM (
            SELECT file_id, method_seq, name AS vulnerability_type, CAST(severity AS DOUBLE) AS severity_score,
              round(conf, 3) AS confidence,
              row_number() OVER (PARTITION BY file_id, method_seq ORDER BY severity DESC, conf DESC, seq) AS r
            FROM (SELECT l_orderkey AS file_id, CAST(l_suppkey % 3 AS INTEGER) AS method_seq, l_partkey % 9 + 1 AS seq,
                    round(CAST(l_discount AS DOUBLE), 2) AS conf FROM lineitem)
            JOIN {SIGNATURE_TABLE} s(seq, name, severity, owasp) USING (seq)) WHERE r = 1""",
        "model_label": with_(LOGGED) + """SELECT model_version, count(*) AS n_scores,
            count(*) FILTER (fallback) AS n_fallback FROM logged GROUP BY model_version""",
        "fallback_fill": with_(LOGGED) + """SELECT file_id, method_seq, vulnerability_type, severity_score, confidence,
            model_version, fallback FROM logged""",
        "has_finding": with_(LOGGED) + """SELECT file_id, method_seq,
            trim(vulnerability_type) <> '' AND upper(vulnerability_type) <> 'NONE' AS has_finding FROM logged""",
        "score_methods": scored + f"""SELECT file_id, method_seq, coalesce(kind, 'NONE') AS vulnerability_type,
            CAST(coalesce(severity, 0) AS DOUBLE) AS severity_score, owasp AS owasp_category,
            coalesce(conf, 0.0) AS confidence, 'rule-only' AS model_version, false AS fallback
            FROM methods LEFT JOIN scores USING (file_id, method_seq)
            LEFT JOIN {SIGNATURE_TABLE} s(seq, name, severity, owasp) ON name = kind""",
        "attach_scores": with_(CODE, METHOD_ROWS) + """SELECT file_id, method_seq, method_name,
            coalesce(source, 'NONE') AS vulnerability_type, CASE WHEN source IS NULL THEN 0.0 ELSE 5.0 END::DOUBLE AS severity_score,
            CASE WHEN source IS NULL THEN 'unavailable' ELSE 'encoder-1' END AS model_version, source IS NULL AS fallback
            FROM methods LEFT JOIN documents ON doc_id = file_id AND method_seq = 1""",
        "score_with_vectors": with_(CODE, CATALOG, METHOD_ROWS, SCORE_ROWS, _VECTOR_SCORES) + """SELECT file_id, method_seq,
            coalesce(kind, 'NONE') AS vulnerability_type, CAST(coalesce(severity, 0) AS DOUBLE) AS severity_score,
            coalesce(certain, 0.0) AS confidence, 'encoder-1' AS model_version
            FROM methods LEFT JOIN certainties USING (file_id, method_seq)""",
        "merged_findings_vectors": with_(CODE, CATALOG, METHOD_ROWS, SCORE_ROWS, FINAL_ROWS, _VECTOR_SCORES) + f"""
            SELECT display_seq, f.severity, file_name, f.file_id, vulnerability_type, line_number, f.method_name, detection_source,
              CASE detection_source WHEN 'AI' THEN certain WHEN 'STATIC' THEN confidence
                ELSE greatest(CASE WHEN vulnerability_type = 'NULL_POINTER_RISK' THEN 0 ELSE confidence END, certain) END AS confidence
            FROM final f LEFT JOIN (
              SELECT file_id, kind, start_line, end_line, max(certain) AS certain FROM (
                SELECT file_id, kind, first_value(start_line) OVER w AS start_line, max(end_line) OVER w AS end_line, certain
                FROM certainties JOIN methods USING (file_id, method_seq) JOIN code USING (file_id)
                WINDOW w AS (PARTITION BY file_id, CASE WHEN t = 13 THEN 0 ELSE method_seq END ORDER BY method_seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY ALL) c
            ON c.file_id = f.file_id AND c.kind = f.vulnerability_type AND line_number BETWEEN start_line AND end_line""",
        # catalog
        "catalog_lookup": with_(CATALOG, TYPED) + """SELECT event_id, typed.vulnerability_type,
            coalesce(display_name, 'Unclassified Issue') AS display_name, coalesce(severity, 'LOW') AS severity,
            coalesce(category, 'LOGIC') AS category, owasp_category,
            CAST(coalesce(rule_confidence, 0.5) AS DOUBLE) AS rule_confidence, severity IS NOT NULL AS is_known
            FROM typed LEFT JOIN catalog ON upper(typed.vulnerability_type) = catalog.vulnerability_type""",
        "severity_weight": """SELECT event_id, severity, CAST(CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 6
            WHEN 'MEDIUM' THEN 3 ELSE 1 END AS INTEGER) AS weight FROM (SELECT event_id, CASE event_type
            WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'click' THEN 'MEDIUM' WHEN 'view' THEN 'LOW' END
            AS severity FROM events)""",
        "score_band": """SELECT event_id, CASE WHEN value / 50 >= 8 THEN 'CRITICAL' WHEN value / 50 >= 6 THEN 'HIGH'
            WHEN value / 50 >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM events""",
        "catalog_coverage": with_(CODE, CATALOG, METHOD_ROWS, HIT_ROWS) + """SELECT c.vulnerability_type, true AS in_catalog,
            c.vulnerability_type <> 'NULL_POINTER_RISK' AS has_rule, true AS has_signature,
            (SELECT count(*) FROM hits h WHERE h.vulnerability_type = c.vulnerability_type) AS n_rule_hits,
            (SELECT count(*) FROM methods m WHERE regexp_matches(code, pattern)) AS n_signature_hits
            FROM catalog c JOIN """ + values(list(patterns.items())) + """ p(name, pattern) ON name = c.vulnerability_type""",
        "catalog_listing": with_(CODE, CATALOG, HIT_ROWS) + """SELECT vulnerability_type, display_name, severity, category,
            owasp_category, (SELECT count(*) FROM hits h WHERE h.vulnerability_type = c.vulnerability_type) AS n_findings
            FROM catalog c""",
        "catalog_counts": with_(CODE, CATALOG, HIT_ROWS) + """SELECT category, owasp_category,
            count(DISTINCT vulnerability_type) AS n_types, count(*) AS n_findings
            FROM hits JOIN catalog USING (vulnerability_type) GROUP BY category, owasp_category""",
        # merge
        "merge_corroborate": with_(CODE, CATALOG, HIT_ROWS, FINAL_ROWS) + """SELECT h.list_seq, h.file_id, h.vulnerability_type,
            h.line AS line_number, h.method_name, f.confidence, f.detection_source FROM hits h JOIN final f
            ON f.file_id = h.file_id AND f.vulnerability_type = h.vulnerability_type AND f.line_number = h.line
            AND f.detection_source <> 'AI'""",
        "merge_ai_only": scored + """SELECT file_id, method_seq, kind AS vulnerability_type, start_line, conf AS confidence
            FROM scores JOIN methods USING (file_id, method_seq) JOIN code USING (file_id) WHERE t IN """ + ONLY_SCORED,
        "merge_nested_hits": scored + """SELECT file_id, method_seq, kind AS vulnerability_type,
            NOT (t = 13 AND method_seq = 2) AS is_appended,
            CAST(CASE WHEN t = 13 AND method_seq = 2 THEN 1 END AS INTEGER) AS absorbed_by
            FROM scores JOIN code USING (file_id) WHERE t IN """ + ONLY_SCORED,
        "merge_order": _static_list("""file_id, CAST(row_number() OVER (PARTITION BY file_id
            ORDER BY weight DESC, line, list_seq) AS INTEGER) AS display_seq, list_seq, vulnerability_type, severity"""),
        "merged_findings": final + f"SELECT display_seq, severity, file_name, {_PLACE} FROM final",
        "merged_findings_degraded": _static_list("""CAST(row_number() OVER (PARTITION BY file_id
            ORDER BY weight DESC, line, list_seq) AS INTEGER) AS display_seq, severity, 'C' || file_id || '.java' AS file_name,
            file_id, vulnerability_type, line AS line_number, method_name, CAST(rule_confidence AS DOUBLE) AS confidence,
            'STATIC' AS detection_source"""),
        # roll-ups
        "severity_counts": everything + """SELECT file_id, total_findings, critical_count, high_count, medium_count, low_count
            FROM records""",
        "risk_score": everything + "SELECT file_id, risk_score FROM records",
        "run_status": """WITH users AS (SELECT c_custkey AS file_id FROM customer UNION SELECT user_id FROM events)
            SELECT file_id, CASE WHEN count(event_id) > 0
              AND count(*) FILTER (event_type <> 'error') = 0
              THEN 'DEGRADED' ELSE 'SUCCESS' END AS ai_engine_status
            FROM users LEFT JOIN events ON user_id = file_id GROUP BY file_id""",
        "methods_analysed": everything + "SELECT file_id, methods_analysed FROM records",
        "analysis_of_stored_sources": everything + "SELECT * FROM records",
        "analysis_records": everything + "SELECT * FROM records",
        "analysis_of_uploads": everything + f"""SELECT code.file_id, risk_score,
            coalesce({UPLOAD_REASON}, {CONTENT_REASON}, CASE t WHEN 15 THEN 'BRACKET_MISMATCH' END) AS reject_reason
            FROM (SELECT file_id, t, file_name, src FROM code) code LEFT JOIN (SELECT file_id, risk_score FROM records) USING (file_id)""",
        "rejected_files": with_(CODE) + f"""SELECT * FROM (SELECT file_id, file_name AS safe_name,
            coalesce({UPLOAD_REASON}, {CONTENT_REASON}, CASE t WHEN 15 THEN 'BRACKET_MISMATCH' END) AS reject_reason,
            CAST(CASE t WHEN 15 THEN 4 + shift END AS INTEGER) AS line FROM code) WHERE reject_reason IS NOT NULL""",
        "count_by_severity": final + "SELECT severity, count(*) AS n_findings FROM final GROUP BY severity",
        "runs_by_status": with_(RUNS) + "SELECT ai_engine_status, count(*) AS n_runs FROM runs GROUP BY ai_engine_status",
        # history and reports
        "recent_runs": with_(RUNS) + "SELECT * FROM runs ORDER BY analysed_at DESC, record_id DESC LIMIT 20",
        "runs_for_file": with_(RUNS) + "SELECT * FROM runs WHERE file_name = 'U8.java' ORDER BY analysed_at DESC, record_id DESC",
        "runs_overview": with_(RUNS) + """SELECT record_id, file_name, total_findings, risk_score, ai_engine_status, analysed_at
            FROM runs ORDER BY analysed_at DESC, record_id DESC""",
        "record_with_findings": everything + """SELECT r.file_id, r.file_name, r.risk_score, r.total_findings AS n_findings,
            display_seq, vulnerability_type, line_number FROM records r LEFT JOIN final USING (file_id)""",
        "findings_for_record": final + f"SELECT {_PLACE} FROM final WHERE file_id = 12",
        "latest_run_findings": final + f"""SELECT {_PLACE}, severity FROM final
            WHERE file_id = (SELECT max(file_id) FROM code WHERE t <> 15) ORDER BY severity""",
        "report_findings": with_(CATALOG, TYPED) + """SELECT event_id, conf AS confidence,
            CAST(floor(coalesce(conf, 0) * 100 + 0.5) AS INTEGER) AS confidence_percent, coalesce(severity, 'LOW') AS severity,
            'sev-' || lower(coalesce(severity, 'LOW')) AS severity_css
            FROM (SELECT *, CASE WHEN event_type <> 'click' THEN round(value / 500, 3) END AS conf FROM typed) t
            LEFT JOIN catalog ON upper(t.vulnerability_type) = catalog.vulnerability_type""",
        "report_runs": with_(RUNS) + """SELECT record_id, file_name, strftime(analysed_at, '%d %b %H:%M') AS when_short,
            strftime(analysed_at, '%d %b %Y, %H:%M') AS when_long, total_findings,
            CASE WHEN critical_count > 0 THEN critical_count || ' critical' END AS critical_badge, risk_score, ai_engine_status,
            CASE ai_engine_status WHEN 'DEGRADED' THEN 'status-degraded' ELSE 'status-online' END AS status_css,
            CASE ai_engine_status WHEN 'DEGRADED' THEN 'DEGRADED' ELSE 'ONLINE' END AS banner FROM runs""",
        "service_labels": """SELECT event_id, CASE event_type WHEN 'error' THEN 'DEGRADED' WHEN 'view' THEN 'ONLINE'
            ELSE 'ONLINE (rule-only)' END AS label, CASE event_type WHEN 'error' THEN 'status-degraded'
            WHEN 'view' THEN 'status-online' ELSE 'status-partial' END AS css_class FROM events""",
        # history of stored results
        "published_records": stored + f"SELECT {_STORED_RECORD} FROM stored",
        "published_findings": stored + f"""SELECT run_date, s.run_id, s.record_id, display_seq, {_PLACE.replace("file_id", "final.file_id", 1)}
            FROM stored s JOIN final ON final.file_id = s.file_id""",
        "stored_recent_runs": stored + f"SELECT {_STORED_RECORD} FROM stored ORDER BY analysed_at DESC, record_id DESC LIMIT 20",
        "stored_runs_for_file": stored + f"SELECT {_STORED_RECORD} FROM stored WHERE file_name = 'C12.java'",
        "stored_latest_findings": stored + f"""SELECT s.run_id, s.record_id, severity, {_PLACE.replace("file_id", "final.file_id", 1)}
            FROM (SELECT * FROM stored ORDER BY analysed_at DESC, file_id DESC LIMIT 1) s JOIN final ON final.file_id = s.file_id""",
        # streams
        "stream_scan": everything + "SELECT * REPLACE ('batch-0/' || file_id AS record_id, 'batch-0' AS run_id) FROM records",
        "stream_reupload": """SELECT sha256(text) AS checksum_sha256, CAST(any_value(strlen(text)) AS INTEGER) AS file_size_bytes,
            true AS has_file FROM documents GROUP BY 1""",
        "stream_status": """SELECT w AS window_start, w + INTERVAL 6 HOUR AS window_end, count(*) AS n_runs,
            count(*) FILTER (event_type = 'error') AS n_degraded,
            round(count(*) FILTER (event_type = 'error') / count(*), 6) AS degraded_share
            FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS w, event_type FROM events)
            WHERE w + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY w""",
    }
    return sql
