"""Wording of findings: what is wrong and how to repair it.

``{name}`` (called method, variable, created type), ``{detail}`` (algorithm,
exception type), ``{param}`` and ``{env}`` are filled per finding.
"""

from __future__ import annotations

# rule name -> (description, remediation)
RULE_TEXTS = {
    "rule_sql_inline": (
        "The call to '{name}' receives a SQL command glued together with '+'. Whoever "
        "controls one of the joined values can rewrite the command.",
        'Use placeholders: prepareStatement("... WHERE col = ?") and bind every value with a setter.',
    ),
    "rule_sql_variable": (
        "Variable '{name}' is given a SQL command glued together with '+'. Any outside value "
        "in it can rewrite the command once it runs.",
        "Keep '{name}' a constant text with ? placeholders and bind the values on the prepared statement.",
    ),
    "rule_hardcoded_secret": (
        "Variable '{name}' holds a credential written into the source. It stays in version "
        "control and in the compiled class.",
        'Read it at run time, for example System.getenv("{env}"), and rotate the exposed value.',
    ),
    "rule_weak_crypto": (
        "Algorithm '{detail}' no longer resists practical attacks and must not protect "
        "passwords or data integrity.",
        "Use SHA-256 or stronger for digests, a salted slow hash for passwords and AES-GCM for encryption.",
    ),
    "rule_command_exec": (
        "The command line handed to '{name}' is built with '+', so shell characters in a "
        "joined value can start other programs.",
        "Pass program and arguments as separate list elements and accept only known values.",
    ),
    "rule_command_builder": (
        "A {name} gets its command as one text built with '+', so a joined value can add "
        "arguments or commands.",
        'Pass each argument on its own: new {name}("/usr/bin/tool", checkedArgument).',
    ),
    "rule_path_traversal": (
        "The path given to {name} is built with '+'. A value holding '../' reaches files "
        "outside the intended folder.",
        "Resolve the name against a base folder, normalise it and refuse it unless it still starts with the base.",
    ),
    "rule_empty_catch": (
        "The handler for '{detail}' does nothing, so failures of this kind pass unseen and the "
        "code runs on in an unknown state.",
        "catch ({detail} {param}): log {param} and rethrow it or handle the failure.",
    ),
    "rule_concat_in_loop": (
        "A text grows with += inside a loop; every round copies all of it again, so the cost is quadratic.",
        "Append to a StringBuilder inside the loop and call toString() once after it.",
    ),
    "rule_resource_leak": (
        "A {name} is opened outside try-with-resources; an exception before close() leaves the "
        "handle open.",
        "try ({name} res = new {name}(...)) { ... } closes it on every path.",
    ),
}

# type -> (description, remediation, anchor) of a text signature
SIGNATURE_TEXTS = {
    "SQL_INJECTION": (
        "A database call is given SQL text joined with a variable; outside input can change the command.",
        "Bind values through PreparedStatement placeholders instead of joining text.",
        "SQL command assembled from strings and outside input",
    ),
    "HARDCODED_SECRET": (
        "A credential is assigned from a text literal and so ships with the source and the class file.",
        "Load the credential from the environment or a secret store.",
        "credential stored as a literal in source code",
    ),
    "WEAK_CRYPTOGRAPHY": (
        "An outdated digest or cipher is requested (MD5, SHA-1 or DES).",
        "Request SHA-256 or AES-GCM, and a slow salted hash for passwords.",
        "outdated hash or cipher used for security",
    ),
    "COMMAND_INJECTION": (
        "An operating system command is joined from text and variables.",
        "Give program and arguments as a list and check them against known values.",
        "operating system command assembled from outside input",
    ),
    "PATH_TRAVERSAL": (
        "A file is opened under a path joined from text and variables.",
        "Normalise the path and require that it stays inside the base folder.",
        "file path assembled from outside input",
    ),
    "EMPTY_CATCH_BLOCK": (
        "An exception is caught and dropped.",
        "Log the exception and rethrow or handle it.",
        "exception swallowed without any handling",
    ),
    "RESOURCE_LEAK": (
        "A closeable object is created without a guarantee that it is closed.",
        "Create it in a try-with-resources header.",
        "file handle or socket never closed",
    ),
    "STRING_CONCAT_IN_LOOP": (
        "A text is extended with += in every round of a loop.",
        "Collect the parts in a StringBuilder.",
        "text extended repeatedly inside a loop",
    ),
    "NULL_POINTER_RISK": (
        "The result of a call that may return null is used at once.",
        "Check the result for null or wrap it in an Optional first.",
        "result used without a null check",
    ),
}

NO_HIT_TEXT = "No known weakness pattern in this snippet."
NO_SCORE_TEXT = "No score was available for this snippet."
