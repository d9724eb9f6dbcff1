"""Tables, word lists, patterns and limits the results depend on."""

from __future__ import annotations

ENGINE_VERSION = "riskweave-1.0.0"

# ---------------------------------------------------------------------------
# Weakness catalog
# (type, display name, severity, category, OWASP 2021 class, rule confidence)
# ---------------------------------------------------------------------------
OWASP_A01 = "A01:2021-Broken Access Control"
OWASP_A02 = "A02:2021-Cryptographic Failures"
OWASP_A03 = "A03:2021-Injection"
OWASP_A07 = "A07:2021-Identification and Authentication Failures"
OWASP_A09 = "A09:2021-Security Logging and Monitoring Failures"

CATALOG = [
    ("SQL_INJECTION", "SQL Injection", "CRITICAL", "SECURITY", OWASP_A03, 0.90),
    ("COMMAND_INJECTION", "OS Command Injection", "CRITICAL", "SECURITY", OWASP_A03, 0.90),
    ("HARDCODED_SECRET", "Hardcoded Credential", "HIGH", "SECURITY", OWASP_A07, 0.85),
    ("WEAK_CRYPTOGRAPHY", "Weak Cryptographic Algorithm", "HIGH", "SECURITY", OWASP_A02, 0.88),
    ("PATH_TRAVERSAL", "Path Traversal", "HIGH", "SECURITY", OWASP_A01, 0.75),
    ("RESOURCE_LEAK", "Unclosed Resource", "MEDIUM", "LOGIC", None, 0.70),
    ("NULL_POINTER_RISK", "Possible Null Dereference", "MEDIUM", "LOGIC", None, 0.60),
    ("EMPTY_CATCH_BLOCK", "Empty Catch Block", "MEDIUM", "LOGIC", OWASP_A09, 0.95),
    ("STRING_CONCAT_IN_LOOP", "String Concatenation in Loop", "LOW", "PERFORMANCE", None, 0.80),
]
CATALOG_DDL = (
    "vulnerability_type string, display_name string, severity string, "
    "category string, owasp_category string, rule_confidence double"
)

# What an unknown or missing type resolves to
UNKNOWN_DISPLAY = "Unclassified Issue"
UNKNOWN_SEVERITY = "LOW"
UNKNOWN_CATEGORY = "LOGIC"
UNKNOWN_CONFIDENCE = 0.50

# Severity weights, score bands, caps
SEVERITY_WEIGHT = {"CRITICAL": 10, "HIGH": 6, "MEDIUM": 3}
OTHER_WEIGHT = 1
MAX_RISK = 100
SCORE_BANDS = [(8.0, "CRITICAL"), (6.0, "HIGH"), (3.0, "MEDIUM")]
LOWEST_BAND = "LOW"
NEUTRAL_CONFIDENCE = 0.5
HINT_BONUS = 0.15
MAX_SNIPPETS = 25
MAX_SNIPPET_CHARS = 20_000
STORED_SNIPPET_CHARS = 1_500
STORED_SNIPPET_SUFFIX = "\n// ... truncated"
MAX_FILE_BYTES = 1_048_576
NUL_SCAN_BYTES = 1_024
HISTORY_SIZE = 20
NAME_CHARS = 120
MIN_SECRET_CHARS = 4

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
CATEGORIES = ["SECURITY", "PERFORMANCE", "LOGIC"]
SOURCES = ["STATIC", "AI", "STATIC+AI"]
STATUSES = ["SUCCESS", "DEGRADED"]
NO_METHOD = "<field or initializer>"
NO_CLASS = "UnknownClass"

# ---------------------------------------------------------------------------
# Word lists and patterns of the structural rules
# ---------------------------------------------------------------------------
SQL_CALLS = ["executeQuery", "executeUpdate", "execute", "createQuery", "createNativeQuery"]
SQL_WORDS = r"(?i)\b(select|insert\s+into|update|delete\s+from)\b"
SECRET_WORDS = r"(?i)(password|passwd|pwd|secret|api_?key|token|credential)"
SECRET_NAME = r"(?i)^\w*(password|passwd|pwd|secret|api_?key|token|credential)\w*$"
PLACEHOLDER = r"(?i)^(|null|none|todo|changeme|change_me|xxx+|\*+|\$\{.*\}|<.*>)$"
WEAK_PREFIXES = ["MD5", "SHA1", "SHA-1", "DES"]
CRYPTO_SCOPES = ["MessageDigest", "Cipher"]
FILE_TYPES = ["File", "FileInputStream", "FileOutputStream", "FileReader", "FileWriter"]
CLOSEABLE_TYPES = [
    "FileInputStream", "FileOutputStream", "BufferedReader", "BufferedWriter",
    "FileReader", "FileWriter", "Socket", "ServerSocket",
]
TYPE_WORDS = ["class", "interface", "enum", "record"]

# ---------------------------------------------------------------------------
# Text signatures, in report order
# (type, pattern, severity 0-10, OWASP 2021 class).  A search for the secret
# pattern needs no leading \w*: it cannot change whether the text matches.
# ---------------------------------------------------------------------------
SIGNATURES = [
    ("SQL_INJECTION",
     r"(?is)(executeQuery|executeUpdate|execute|createQuery|createNativeQuery)\s*\("
     r"[^;]*\b(SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b[^;]*\+",
     9.0, OWASP_A03),
    ("HARDCODED_SECRET",
     r'(?i)(password|passwd|pwd|secret|api_?key|token|credential)\w*\s*=\s*"[^"]{3,}"',
     7.5, OWASP_A07),
    ("WEAK_CRYPTOGRAPHY",
     r'(?i)MessageDigest\.getInstance\s*\(\s*"(MD5|SHA-?1)"\s*\)|Cipher\.getInstance\s*\(\s*"DES',
     7.0, OWASP_A02),
    ("COMMAND_INJECTION",
     r"(?i)(Runtime\.getRuntime\(\)\.exec|ProcessBuilder)\s*\([^)]*\+",
     9.5, OWASP_A03),
    ("PATH_TRAVERSAL",
     r"(?i)new\s+(File|FileInputStream|FileReader)\s*\([^)]*\+",
     7.5, OWASP_A01),
    ("EMPTY_CATCH_BLOCK",
     r"catch\s*\([^)]*\)\s*\{\s*\}",
     4.0, OWASP_A09),
    ("RESOURCE_LEAK",
     r"new\s+(FileInputStream|FileOutputStream|BufferedReader|Connection|Socket)\s*\(",
     5.0, None),
    ("STRING_CONCAT_IN_LOOP",
     r"""(?s)for\s*\([^)]*\)\s*\{[^}]*?\w+\s*\+=\s*[^;]*["']""",
     3.5, None),
    ("NULL_POINTER_RISK",
     r"\.get\(\s*\)\s*\.\w+\(|\bgetParameter\([^)]*\)\s*\.\w+\(",
     4.5, None),
]

# A literal each signature cannot match without; checked first because it is
# far cheaper than the pattern.  Only caseless literals (symbols) are used for
# the patterns that ignore case.
SIGNATURE_GUARDS = {
    "SQL_INJECTION": ["(", "+"],
    "HARDCODED_SECRET": ["=", '"'],
    "WEAK_CRYPTOGRAPHY": [".", "(", '"'],
    "COMMAND_INJECTION": ["(", "+"],
    "PATH_TRAVERSAL": ["(", "+"],
    "EMPTY_CATCH_BLOCK": ["catch", "{"],
    "RESOURCE_LEAK": ["new", "("],
    "STRING_CONCAT_IN_LOOP": ["for", "+="],
    "NULL_POINTER_RISK": [".", "("],
}

# ---------------------------------------------------------------------------
# Java words (language specification)
# ---------------------------------------------------------------------------
JAVA_PRIMITIVES = ["boolean", "byte", "char", "short", "int", "long", "float", "double", "void"]
JAVA_KEYWORDS = [
    "abstract", "assert", "break", "case", "catch", "class", "const", "continue", "default",
    "do", "else", "enum", "extends", "final", "finally", "for", "goto", "if", "implements",
    "import", "instanceof", "interface", "native", "new", "package", "private", "protected",
    "public", "return", "static", "strictfp", "super", "switch", "synchronized", "this",
    "throw", "throws", "transient", "try", "volatile", "while", "true", "false", "null",
]
# Java operators that bind more loosely than '+'
LOOSER_THAN_PLUS = [
    "<", ">", "<=", ">=", "==", "!=", "&&", "||", "&", "|", "^", "?", ":", "->", "instanceof",
    "<<", "=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=",
]

# Java source: a body without statements at the end; the last comment and type parameters before the end, with blanks
EMPTY_BODY = r"\{[ \t\n\x0B\f\r]*\}$"
METHOD_LEAD = r"(?s)(?:(?:/\*(?:(?!\*/).)*+\*/|//[^\n\r]*)[ \t\n\r\f]*)?(?:<[^;{}/]*>[ \t\n\r\f]*)?$"

# Style classes of the report pages
SEVERITY_CSS = {"CRITICAL": "sev-critical", "HIGH": "sev-high", "MEDIUM": "sev-medium", "LOW": "sev-low"}
STATUS_CSS = {"DEGRADED": "status-degraded", "ONLINE": "status-online", "PARTIAL": "status-partial"}
