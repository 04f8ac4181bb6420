"""Weakness scans: symbols in, findings (cwe, title, function, file, severity) out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sink keyword to weakness; the longest keyword that fits decides.
SINKS = {
    "echo": 79, "print": 79, "innerHTML": 79, "document.write": 79, "query": 89, "mysqli_query": 89, "execute": 89, "exec": 78, "system": 78,
    "shell_exec": 78, "passthru": 78, "popen": 78, "subprocess": 78, "eval": 94, "create_function": 94, "include": 98, "require": 98, "fopen": 22,
    "file_get_contents": 918, "open": 22, "header": 601, "setcookie": 614, "log": 532, "error_log": 532,
}
# Part of a warning to weakness and severity, in order.
WARNINGS = (
    ("sql injection risk", 89, "HIGH"), ("hardcoded credentials", 798, "CRITICAL"), ("insecure deserialization", 502, "HIGH"),
    ("potential path traversal", 22, "HIGH"), ("use of eval", 94, "CRITICAL"), ("aliasing risky functions", 94, "HIGH"), ("debug=true", 1188, "MEDIUM"),
    ("insecure file permissions", 276, "MEDIUM"), ("unbounded loop", 400, "MEDIUM"), ("memory safety: potential unbounded", 400, "MEDIUM"),
    ("concurrency risk", 362, "MEDIUM"), ("insecure default", 1188, "MEDIUM"), ("blocking call", 400, "LOW"),
)
# Words and patterns of the scans.
SENSITIVE = ("password", "secret", "token", "api_key", "credential", "private_key")
SANITISERS = ("mask", "sanitize", "hash", "strip", "redact")
INTERNAL = "(?i)^test_|^mock_|_test$|internal_|^calibrate|sync_library"
API_CODE = r"@app\.(get|post|put|delete|patch|route)|@router\.|@authorized|@requires|@protected|handler|controller|endpoint|api"
API_WORDS = ("api", "endpoint", "handler", "request", "public")
OWNERS = ("owner", "sender", "user_id", "caller")
CHECKS = ("==", "!=", "if ", "assert", "require", "throw", "raise")
CREDENTIAL = r"(?i)\b(password|secret|api_key|token|credential|auth_key|private_key)\b\s*[:=]\s*[\"'][^\"']{3,}[\"']"
LOG_SINK = r"(?i)\b(print|log|logger\.|console\.log|error_log)\b"
STORED = r"(?i)\b(password|secret|token|credential|api_key)\b"
STORAGE = r"(?i)\b(open\s*\(|write\s*\(|json\.dump|yaml\.dump|pickle\.dump|sqlite3|INSERT\s+INTO)\b"
SAFE_STORAGE = r"(?i)\b(hash|bcrypt|sha|pbkdf2|encrypt|AES)\b"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda out, w: out | F.contains(text, F.lit(w)), words, F.lit(False))


def _finding(cwe: int, title: str, severity: Column | str) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(f"CWE-{cwe}").alias("cwe"), F.lit(title).alias("title"), F.col("name").alias("function"), F.coalesce("file", F.lit("unknown")).alias("file"), level.alias("severity"))


def _code() -> Column:
    return F.coalesce("code", F.lit(""))


def hardcoded_credentials() -> Column:
    return F.when(_code().rlike(CREDENTIAL), _finding(798, "Hardcoded Credentials", "CRITICAL"))


def sensitive_in_logs() -> Column:
    named = _code().rlike(rf"(?i)\b({'|'.join(SENSITIVE)})\b")
    return F.when(_code().rlike(LOG_SINK) & named & ~_any(F.lower(_code()), SANITISERS), _finding(532, "Sensitive Info in Logs", "MEDIUM"))


def cleartext_storage() -> Column:
    hit = _code().rlike(STORED) & _code().rlike(STORAGE) & ~_code().rlike(SAFE_STORAGE)
    return F.when(hit, _finding(312, "Cleartext Storage of Sensitive Information", "HIGH"))


def endless_loop() -> Column:
    hit = _code().rlike(r"\bwhile\s+True\b") & ~_code().rlike(r"\bbreak\b|\breturn\b|\braise\b")
    return F.when(hit, _finding(400, "Uncontrolled Resource Consumption (Infinite Loop)", "HIGH"))


def no_timeout() -> Column:
    return F.when(_any(_code(), ("requests.",)) & ~_any(_code(), ("timeout=",)), _finding(400, "HTTP Request Without Timeout", "MEDIUM"))


def of_code(symbols: DataFrame, scans: tuple | None = None) -> DataFrame:
    """The findings of scans that look at one symbol's code, all in one pass; a null code or docstring is empty."""
    scans = scans or (sensitive_in_logs, hardcoded_credentials, endless_loop, no_timeout, cleartext_storage)
    return symbols.select(F.inline(F.array_compact(F.array(*[f() for f in scans]))))


def missing_authorization(symbols: DataFrame, rules: DataFrame) -> DataFrame:
    """Reachable, important symbols without an authorization rule (anti-join)."""
    guarded = rules.where("category = 'authorization'").select(F.col("source_function").alias("name")).distinct()
    score = F.coalesce("score", F.lit(0.0))
    weight = (score > 0.4) | (F.coalesce("mass", F.lit(0.0)) > 1.2) | F.coalesce("exported", F.lit(False))
    api = _code().rlike(API_CODE) | _any(F.lower(F.coalesce("docstring", F.lit(""))), API_WORDS) | F.coalesce("exported", F.lit(False))
    own = ~F.col("name").rlike(INTERNAL) & ~_any(F.lower(F.coalesce("file", F.lit("unknown"))), ("test",))
    level = F.when(score > 0.8, "CRITICAL").otherwise("HIGH")
    return symbols.where(own & weight & api).join(guarded, "name", "left_anti").select(F.inline(F.array(_finding(862, "Missing Authorization", level))))


def incorrect_authorization(symbols: DataFrame, rules: DataFrame) -> DataFrame:
    """Authorization rules that name an owner whose function (the first of its name by ``seq`` where symbols have it, else by file) never compares or refuses."""
    stated = rules.where((F.col("category") == "authorization") & _any(F.lower("description"), OWNERS))
    first = symbols.groupBy("name").agg(F.min_by(F.struct("file", "code"), F.struct(*[c for c in ("seq", "file", "code") if c in symbols.columns])).alias("s")).select("name", "s.file", "s.code")
    both = stated.select(F.col("source_function").alias("name")).join(first, "name").where(~_any(F.lower(_code()), CHECKS))
    return both.select(F.inline(F.array(_finding(863, "Incorrect Authorization (Potential Bypass)", "HIGH"))))


def exposed_by_rule(symbols: DataFrame, rules: DataFrame) -> DataFrame:
    """Sensitive symbols, by name or docstring, with each event or io rule that names no sanitiser."""
    open_rules = rules.where(F.col("category").isin("event", "io") & ~_any(F.lower("description"), SANITISERS)).select(F.col("source_function").alias("name"))
    hot = symbols.where(_any(F.lower("name"), SENSITIVE) | _any(F.lower(F.coalesce("docstring", F.lit(""))), SENSITIVE))
    return hot.join(open_rules, "name").select(F.inline(F.array(_finding(532, "Sensitive Information Exposure", "MEDIUM"))))


def sink_weakness(sink: Column) -> Column:
    """Weakness of a sink expression: the longest keyword that is a word of it, whatever the case."""
    out = F.lit(None).cast("int")
    for key in reversed(sorted(SINKS, key=len, reverse=True)):  # of equally long ones the first listed
        pattern = "(?i)(^|[^A-Za-z0-9_])" + key.replace(".", "[.]") + "($|[^A-Za-z0-9_])"
        out = F.when(sink.rlike(pattern), F.lit(SINKS[key])).otherwise(out)
    return out


def tainted_sinks(flows: DataFrame) -> DataFrame:
    """Tainted flow paths (file, line, variable, sink, state, seq), one finding for each place, variable and weakness.

    It is reported for the path's function where flows have one, else for the sink.
    """
    named = "function" if "function" in flows.columns else "sink"
    hit = flows.where("state = 'TAINTED'").withColumn("weakness", sink_weakness(F.col("sink"))).where("weakness is not null")
    return (
        hit.groupBy("file", "line", "variable", "weakness").agg(F.min_by(named, "seq").alias("function"))
        .select(F.format_string("CWE-%d", "weakness").alias("cwe"), F.lit("Tainted data reaches a sink").alias("title"), "function", "file", F.lit("CRITICAL").alias("severity"))
    )


def from_warning(warning: Column) -> Column:
    """struct(cwe, severity) of a warning text; the first part that fits decides, so a part that holds an earlier one is not listed."""
    low, out = F.lower(warning), F.lit(None).cast("struct<cwe:string,severity:string>")
    for part, cwe, severity in reversed(WARNINGS):
        out = F.when(low.contains(part), F.struct(F.lit(f"CWE-{cwe}").alias("cwe"), F.lit(severity).alias("severity"))).otherwise(out)
    return out


def parser_warnings(warnings: DataFrame) -> DataFrame:
    """Warnings (name, file, warning) that stand for a weakness; the title is the first 80 characters of the warning."""
    hit = warnings.withColumn("hit", from_warning(F.col("warning"))).where("hit is not null")
    return hit.select("hit.cwe", F.substring("warning", 1, 80).alias("title"), F.col("name").alias("function"), "file", "hit.severity")


def all_scans(symbols: DataFrame, rules: DataFrame, flows: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """The union of all scans; those of flow paths and parser warnings where these are given."""
    parts = [of_code(symbols), *(f(symbols, rules) for f in (missing_authorization, incorrect_authorization, exposed_by_rule))]
    parts += [f(x) for f, x in ((tainted_sinks, flows), (parser_warnings, warnings)) if x is not None]
    return reduce(DataFrame.unionByName, parts)
