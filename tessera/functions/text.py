"""Text predicates and labels of symbols, files and rules."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffix to language, in the order they are tried.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".sol": "solidity", ".go": "go",
    ".rs": "rust", ".java": "java", ".rb": "ruby", ".php": "php", ".c": "cpp", ".cpp": "cpp", ".h": "cpp", ".hpp": "cpp", ".cc": "cpp",
    ".cxx": "cpp", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".json": "json",
}

# Keywords of each rule category, categories in the order that decides ties.
RULE_KEYWORDS = {
    "validation": (
        "valid", "validate", "validates", "check", "checks", "verify", "verifies", "ensures", "assert", "require", "constraint", "schema", "format",
        "length", "range", "zero", "null", "empty", "invalid", "sanitize",
    ),
    "authorization": (
        "owner", "only", "access", "permission", "role", "admin", "authorize", "authorized", "restrict", "restricted", "privilege", "onlyowner",
        "requires", "caller", "sender", "whitelist", "blacklist",
    ),
    "computation": (
        "calculate", "calculates", "compute", "computes", "hash", "sign", "encrypt", "multiply", "divide", "sum", "average", "aggregate", "formula",
        "interest", "price", "score", "weight", "balance",
    ),
    "io": (
        "fetch", "read", "write", "save", "load", "store", "database", "db", "http", "api", "request", "response", "upload", "download", "file",
        "stream", "socket", "network", "send", "receive",
    ),
    "event": (
        "emit", "emits", "event", "log", "logs", "notify", "notification", "trigger", "dispatch", "publish", "broadcast", "webhook", "callback",
    ),
}

# Name patterns and the label each gives, first match wins.
TAINT_LABELS = (
    (r"\buser[-_]?id\b", "USER_ID"), (r"\bsession[-_]?id\b", "SESSION_ID"), (r"\btoken\b", "AUTH_TOKEN"), (r"\bpassword|passwd\b", "CREDENTIAL"),
    (r"\border[-_]?id\b", "RESOURCE_ID"), (r"\bquery\b", "SQL_SINK"), (r"\bcmd|command\b", "CMD_SINK"), (r"\bfile[-_]?path|filename\b", "PATH_SINK"),
    (r"\bheader\b", "HTTP_HEADER"), (r"\binput\b", "USER_INPUT"), (r"\bpayload\b", "USER_INPUT"), (r"\bprice|amount|total\b", "FINANCIAL_VALUE"),
    (r"\brole|permission\b", "PRIVILEGE_LABEL"),
)

DOC_FILES = r"\.(md|json|txt|ya?ml|lock|log)$"
DOC_NAMES = "readme|changelog|license|contributors|authors"


def language_of(path: Column) -> Column:
    """Language by suffix, generic where none fits; case matters."""
    out = F.lit("generic")
    for suffix, name in reversed(LANGUAGES.items()):
        out = F.when(path.endswith(suffix), F.lit(name)).otherwise(out)
    return out


def is_documentation(path: Column, name: Column) -> Column:
    """Whether a symbol belongs to documentation or configuration rather than code."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return low.rlike(DOC_FILES) | low.rlike(DOC_NAMES) | F.lower(F.coalesce(name, F.lit(""))).rlike(DOC_NAMES)


def kind_of(labels: Column) -> Column:
    """The leading kind among a symbol's labels, Function by default."""
    out = F.lit("Function")
    for kind in ("Module", "Function", "Method", "Variable", "Enum", "Interface", "Class"):
        out = F.when(F.array_contains(labels, kind), F.lit(kind)).otherwise(out)
    return out


def qualified(file: Column, name: Column) -> Column:
    return F.when(name.contains(":"), name).otherwise(F.concat_ws(":", file, name))


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, ":"), -1)


def taint_label(name: Column, constants: Column | None = None, overrides: dict[str, str] | None = None) -> Column:
    """Semantic label of a variable: user overrides (exact, then pattern), known constants, built-in patterns, else GENERIC_TAINT."""
    plain = F.lower(F.ltrim(name, F.lit("$")))
    out = F.lit("GENERIC_TAINT")
    for pattern, label in reversed(TAINT_LABELS):
        out = F.when(plain.rlike(pattern), F.lit(label)).otherwise(out)
    if constants is not None:
        out = F.when(constants, F.lit("SAFE_CONSTANT")).otherwise(out)
    for key, label in reversed((overrides or {}).items()):
        out = F.when(plain.rlike(f"(?i){key}"), F.lit(label)).otherwise(out)
    for key, label in reversed((overrides or {}).items()):
        out = F.when(plain == key.lower().lstrip("$"), F.lit(label)).otherwise(out)
    return out


def category_scores(words: Column) -> dict[str, Column]:
    """Score of each rule category: keyword hits over a tenth of its keywords (one at least), 1 at most."""
    out = {}
    for category, keys in RULE_KEYWORDS.items():
        keys = sorted(set(keys))
        hits = F.size(F.array_intersect(F.array_distinct(words), F.array(*map(F.lit, keys))))
        out[category] = F.least(hits / F.lit(max(0.1 * len(keys), 1.0)), F.lit(1.0))
    return out


def best_category(words: Column) -> Column:
    """The category with the greatest score, the first of equals; null without any hit."""
    scores = category_scores(words)
    top = F.greatest(*scores.values())
    out = F.lit(None).cast("string")
    for category, score in reversed(scores.items()):
        out = F.when(score == top, F.lit(category)).otherwise(out)
    return F.when(top > 0, out)


def inline_category(rule: Column) -> Column:
    """The plainer taxonomy that the report uses: the first substring that fits."""
    low = F.lower(rule)
    return (
        F.when(low.rlike("auth|permission"), "authorization").when(low.rlike("event|log"), "event").when(low.rlike("read|write|file|db|query"), "io")
        .when(low.rlike("validate|check"), "validation").otherwise("generic")
    )


def dependency_type(kind: Column, target: Column) -> Column:
    """api before internal (./ and ../) before relative imports before external."""
    k, t = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(target, F.lit("")))
    return (
        F.when(k.contains("api") | k.contains("http") | t.startswith("http://") | t.startswith("https://"), "api").when(t.startswith("./") | t.startswith("../"), "internal")
        .when(k.contains("relative"), "internal").otherwise("external")
    )


def keyword_rules(text: Column) -> Column:
    """Lines of more than ten characters that state a rule."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (F.length(x) > 10) & F.lower(x).rlike("must|should|ensure|valid|check|verify|only"))


def slug(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")


def safe_name(name: Column) -> Column:
    """A file name: odd characters replaced, over 60 characters cut and told apart by a hash."""
    plain = F.regexp_replace(name, r"[^a-zA-Z0-9_\-]", "_")
    return F.when(F.length(plain) > 60, F.concat(F.substring(plain, 1, 50), F.lit("_"), F.substring(F.md5(name.cast("binary")), 1, 6))).otherwise(plain)


def masked(name: Column, value: Column) -> Column:
    return F.when(F.lower(name).rlike("pass|secret|key|token") & (value != ""), F.lit("********")).otherwise(value)


def table_cell(text: Column, most: int = 80) -> Column:
    """A text as a table's cell: one line, bars escaped, cut at ``most`` characters; a dash for none."""
    flat = F.replace(F.replace(F.regexp_replace(F.regexp_replace(text, "\n", " "), "\r", ""), F.lit("|"), F.lit("\\|")), F.lit('"'), F.lit("'"))
    cut = F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)
    return F.when(text.isNull() | (text == ""), F.lit("—")).otherwise(cut)


def is_code(path: Column) -> Column:
    """Files whose drift is measured."""
    return path.rlike(r"\.(py|js|ts|tsx|jsx|go)$")


def meaning(content: Column) -> Column:
    """What an added file says first."""
    return F.trim(F.replace(F.substring(content, 1, 300), F.lit("\n"), F.lit(" ")))


def glob(pattern: str) -> str:
    """A shell pattern as a regular expression."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def ignored(path: Column, patterns: tuple[str, ...] = ("*.md", "package-lock.json")) -> Column:
    """Whether a path or its base name fits one of the patterns."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob(p)) | base.rlike(glob(p))
    return out


def branch_name(name: str) -> str:
    """The name itself; ValueError for one that is empty, begins with a dash or has other characters than a branch's."""
    if not name or name.startswith("-") or not re.fullmatch(r"[a-zA-Z0-9_\-/.+]+", name):
        raise ValueError(f"no branch name: {name!r}")
    return name


def within(folder: str, *parts: str) -> str:
    """The path of ``parts`` in ``folder``; ValueError if it leads out of it."""
    top = posixpath.abspath(folder)
    path = posixpath.abspath(posixpath.join(top, *parts))
    if path != top and not path.startswith(top.rstrip("/") + "/"):
        raise ValueError(f"{path} is outside of {top}")
    return path


def literal_type(value: Column) -> Column:
    """The type a literal seems to have."""
    v = F.regexp_replace(value, r"^\s+|\s+$", "")
    return (
        F.when(v.isNull() | (v == ""), "unknown").when(v.rlike("""(?s)^(['"]).*\\1$|^['"]$"""), "string").when(v.startswith("[") | v.startswith("array(") | v.endswith("]"), "array")
        .when(v.startswith("new "), "object").when(F.lower(v).isin("true", "false"), "boolean").when(v.rlike(r"^[0-9]*\.?[0-9]*$") & v.rlike("[0-9]"), "number").otherwise("dynamic")
    )


def rules_of(name: Column, stated: Column, docstring: Column, code: Column) -> Column:
    """The rules of a record, array<struct<category, description, source_function, confidence>>.

    Stated ones of a category come first, else the docstring's beginning with a confidence of 0.6 at most; then what the code has: guards and schema checks.
    """
    words = lambda t: F.split(F.lower(t), r"\W+")

    def rule(category: Column, description: Column, confidence: Column) -> Column:
        return F.struct(category.alias("category"), description.alias("description"), name.alias("source_function"), confidence.cast("double").alias("confidence"))

    def scored(t: Column, said: Column, most: float) -> Column:
        def of(w: Column) -> Column:
            return rule(best_category(w), said, F.least(F.greatest(*category_scores(w).values()), F.lit(most)))

        return F.get(F.transform(F.array(words(t)), of), 0)

    own = F.filter(F.transform(F.coalesce(stated, F.array()), lambda t: scored(t, t, 1.0)), lambda r: r["category"].isNotNull())
    doc, snippet = F.coalesce(docstring, F.lit("")), F.coalesce(code, F.lit(""))
    fallback = F.filter(F.array(scored(doc, F.regexp_replace(F.substring(doc, 1, 200), r"^\s+|\s+$", ""), 0.6)), lambda r: r["category"].isNotNull() & (F.trim(doc) != ""))
    guard = snippet.rlike(r"(?i)@\w*(authorized|requires|guard|protected|auth)\b") | snippet.rlike(r"(?i)\b(check_permission|is_admin|has_role|authorize)\s*\(")
    schema = snippet.rlike(r"(?i)\b(zod|yup|joi|validator|schema)\.(parse|validate|check)\b")
    found = [
        F.when(where, rule(F.lit(category), F.lit(said), F.lit(0.85)))
        for where, category, said in ((guard, "authorization", "Technical authorization check detected in code"), (schema, "validation", "Technical schema validation detected in code"))
    ]
    return F.concat(F.when(F.size(own) > 0, own).otherwise(fallback), F.array_compact(F.array(*found)))
