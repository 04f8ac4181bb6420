"""Coding-standard rules as column expressions: a symbol's record in, warnings out.

Each rule gives an array of warning texts, empty where it holds. Texts are what other operators look for, so they are fixed values, as are
the patterns. Patterns on code see it without comments; those of ``BARE`` without the contents of strings as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import docstrings

# Fixed values.
VERBS = (
    "get", "set", "calculate", "validate", "fetch", "parse", "process", "run", "check", "update", "delete", "create", "load", "save", "handle",
    "start", "stop", "is", "has", "should", "can", "extract", "write", "read",
)
PATH_VERBS = ("get", "set", "fetch", "delete", "update")
VALIDATORS = ("zod", "yup", "joi", "schema", "validate")
OBVIOUS = ("increment", "get", "getter", "return", "obvious")
UNREMARKABLE = (-1.0, 0.0, 1.0, 100.0)
BLOCKING = {
    "time.sleep": "await asyncio.sleep()", "requests.": "httpx or aiohttp", "subprocess.": "asyncio.create_subprocess_exec()", "shutil.": "executor or async alternative",
}
DOCUMENTED = ("python", "javascript", "typescript", "solidity", "rust", "cpp", "c")
RISKY = r"(eval|exec|os\.system|subprocess\.(?:run|call|Popen))"
FLAG = r"\b(is_[a-zA-Z0-9_]+|has_[a-zA-Z0-9_]+|enable|disable|active)"
COMMENTS = (r"(?s)/\*.*?\*/", r'(?s)"""\s*.*?\s*"""', r"(?s)'''\s*.*?\s*'''", r"//[^\n]*", r"#[^\n]*")
STRINGS = ((r'"[^"\\]*(?:\\.[^"\\]*)*"', '""'), (r"'[^'\\]*(?:\\.[^'\\]*)*'", "''"), (r"`[^`\\]*(?:\\.[`\\]*)*`", "``"))

#: Rules that are a pattern, words that must not be there, and a text.
PATTERNS = {
    "LR-05": (r"(?i)\bselect\s*\(\s*['\"]?\*['\"]?\s*\)|\bselect\s+\*", (), "SQL SELECT * performance check: avoid select('*') or SELECT *"),
    "LR-07": (r":\s*any\b|\bas\s+any\b", (), "Type safety: warn if : any or as any type annotation is used"),
    "LR-09": (r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*\}", (), "Empty catch block: try/catch block contains empty catches (silent failures)"),
    "LR-11": (rf"\b{RISKY}\s*\(", (), "Security critical: use of eval(), exec(), os.system(), or subprocess is risky"),
    "LR-12": (rf"\b\w+\s*=\s*{RISKY}\b", (), "Security critical: aliasing risky functions (eval/exec/system) is a common obfuscation tactic"),
    "LR-13": (r"(?i)\b(password|secret|api_key|token|credential|auth_key)\b\s*[:=]\s*[\"'][^\"']{3,}[\"']", (), "Hardcoded credentials: plain-text secrets or keys detected in code"),
    "LR-14": (r"\bDEBUG\s*=\s*True\b|\bdebug\s*=\s*True\b", (), "Insecure default: DEBUG=True or debug=True found in code"),
    "LR-15": (r"(?is)\.(?:execute|query)\s*\(\s*(?:f[\"']|[\"'].*?\+.*?[\"'])", (), "SQL injection risk: string concatenation or f-strings in SQL query"),
    "LR-16": (r"requests\.", ("timeout=",), "Production risk: requests call missing a timeout"),
    "LR-17": (r"while True", ("break", "return", "raise"), "Unbounded loop: while True found without a clear exit condition (break/return/raise)"),
    "LR-18": (r"\bexcept[^:]*:\s*(?:pass|#\s*.*)\s*(?:\n|$)", (), "Silent failure (Python): except block contains only pass or is empty"),
    "LR-19": (r"\b(pickle\.load|pickle\.loads|yaml\.load)\b\s*\(", ("SafeLoader",), "Security risk: insecure deserialization (pickle or unsafe yaml.load) detected"),
    "LR-20": (r"\bopen\s*\(\s*[^,)]*([f\"]|\+).*[\"]", (), "Security risk: potential path traversal (unvalidated string concatenation in open())"),
    "LR-21": (r"\bos\.chmod\s*\(.*?(?:0o777|777|0777)\b", (), "Security risk: insecure file permissions (chmod 777) detected"),
    "LR-23": (r"(?s)\b(while|for)\b.*?\n(\s+).*?\.(append|add|update|extend)\(", ("len(", "clear()", "pop("), "Memory safety: potential unbounded collection growth in loop (no len check or clear)"),
    "LR-24": (r"\bglobal\s+\w+", (), "Concurrency risk: use of 'global' keyword detected; ensure thread-safety with locks"),
    "LR-25": (r"@lru_cache", ("maxsize=",), "Memory safety: @lru_cache used without explicit maxsize (defaults to 128, but explicit is better)"),
}
BARE = {
    "LR-29": (r"\b(let|const|var)\s+([a-zA-Z])\b|\b([a-zA-Z])\s*=[^=\n]", "Short/vague variable name detected"),
    "LR-30": (r"\.(push|pop|splice|shift|unshift)\(", "Immutability violation: mutation methods used"),
}


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    """Lines; what ends a text ends no further line, and an empty text has none."""
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.regexp_replace(text, r"(?:\r\n|\n|\r)\z", ""), r"\r\n|\n|\r"))


def without_comments(code: Column) -> Column:
    for pattern in COMMENTS:
        code = F.regexp_replace(code, pattern, "")
    return code


def without_strings(plain: Column) -> Column:
    for pattern, blank in STRINGS:
        plain = F.regexp_replace(plain, pattern, blank)
    return plain


def inside(signature: Column) -> Column:
    """What is between a signature's first opening and last closing parenthesis."""
    return F.regexp_extract(signature, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)


def params_of(signature: Column) -> Column:
    """The parameters of a signature: commas in brackets (eight deep) and strings don't part them."""
    flat = F.regexp_replace(F.regexp_replace(inside(signature), r"(?s)\\.", ""), r"(?s)\"[^\"]*\"|'[^']*'|`[^`]*`", "")
    for _ in range(8):
        flat = F.regexp_replace(flat, r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}", "x")
    return F.filter(F.transform(F.split(flat, ","), stripped), lambda x: x != "")


def _words(text: Column, other: str) -> Column:
    """Lower-case words, parted before capitals and at ``other`` characters."""
    apart = F.regexp_replace(F.regexp_replace(text, "([A-Z])", " $1"), other, " ")
    return F.filter(F.split(F.lower(apart), r"\s+"), lambda x: x != "")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def findings(code: Column, name: Column, signature: Column, docstring: Column, path: Column, kind: Column, language: Column) -> dict[str, Column]:
    """The warnings of each rule, by identifier, in the order in which a record's warnings come; nulls are empty.

    For single rules; ``warnings`` and ``broken`` strip a record's code once for all of them.
    """
    plain = without_comments(F.coalesce(code, F.lit("")))
    return _findings(code, name, signature, docstring, path, kind, language, plain, without_strings(plain))


def _findings(code: Column, name: Column, signature: Column, docstring: Column, path: Column, kind: Column, language: Column, plain: Column, bare: Column) -> dict[str, Column]:
    code, signature, path, docstring = (F.coalesce(x, F.lit("")) for x in (code, signature, path, docstring))
    out: dict[str, Column] = {}

    def warn(rule: str, broken: Column, text: str | Column) -> None:
        text = F.lit(text) if isinstance(text, str) else text
        none = F.expr("cast(array() as array<string>)")
        out[rule] = F.coalesce(F.when(broken, F.array(text)).otherwise(none), none)

    warn("LR-01", F.size(params_of(signature)) >= 5, "Parameter count smell: function has 5 or more parameters in signature")
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    file, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    warn("LR-02", F.array_contains(folders, "components") & ~stem.rlike("^[A-Z][a-zA-Z0-9]*$"), F.concat(F.lit("File in components/ must be PascalCase. Got: "), file))
    warn("LR-03", F.array_contains(folders, "hooks") & ~stem.rlike("^use[A-Z][a-zA-Z0-9]*$"), F.concat(F.lit("File in hooks/ must be camelCase starting with 'use'. Got: "), file))
    below = F.array_join(F.slice(parts, F.array_position(parts, "api").cast("int") + 1, F.size(parts)), "/")
    verb = F.get(F.filter(_words(below, "[^a-zA-Z0-9]"), lambda w: w.isin(*PATH_VERBS)), 0)
    warn("LR-04", F.array_contains(folders, "api") & verb.isNotNull(), F.concat(F.lit("API endpoint path uses standard verb '"), verb, F.lit("'. Got: "), path))
    for rule, (pattern, spared, text) in PATTERNS.items():
        warn(rule, plain.rlike(pattern) & ~_any(plain, spared), text)
    warn("LR-06", (plain != "") & signature.rlike(r"(?i)\b(req|request)\b") & ~_any(F.lower(plain), VALIDATORS), "Input validation schema check: Request/req parameter is not checked against zod/yup/joi/schema/validate")
    direct = F.exists(F.regexp_extract_all(plain, F.lit(r"(?s)\bset[A-Z]\w*\((.*?)\)"), F.lit(1)), lambda x: ~_any(x, ("=>", "function")))
    warn("LR-08", direct, "React state updates: warn if a component updates state directly instead of using functional updates")
    replies = plain.rlike(r"\b(?:res|response|Response)\.json\s*\(|\bJSON\.stringify\s*\(") & ~F.contains(plain, F.lit("success"))
    warn("LR-10", F.array_contains(parts, "api") & replies, "API response format check: JSON responses in endpoint files (or methods starting with HTTP verbs under api/ path) must include a 'success' field")
    blocking = [F.when(F.contains(plain, F.lit("async def")) & F.contains(plain, F.lit(c)), F.lit(f"Async safety: blocking call '{c}' detected in async function. Use {a} instead.")) for c, a in BLOCKING.items()]
    out["LR-22"] = F.array_compact(F.array(*blocking))
    first = F.get(_words(name, "_"), 0)
    warn("LR-26", ~kind.isin("Class", "Interface", "Enum", "Variable", "Module") & ~first.isin(*VERBS), F.concat(F.lit("Function naming does not follow verb-noun pattern (e.g. fetchMarketData). Got: "), name))
    lines = lines_of(code)
    warn("LR-27", F.size(lines) > 50, "Function is too long (> 50 lines)")
    deep = F.transform(lines, lambda x: x.rlike(r"^\s{16}") | x.rlike(r"\t[^\t]*\t[^\t]*\t[^\t]*\t"))
    warn("LR-28", F.array_contains(deep, True), F.concat(F.lit("Deep nesting detected (> 3 levels) around line "), F.array_position(deep, True).cast("string")))
    for rule, (pattern, text) in BARE.items():
        warn(rule, bare.rlike(pattern), text)
    warn("LR-31", bare.rlike(r"\b(fetch|open)\b") & ~bare.rlike(r"\b(try|except|catch)\b"), "Missing try/catch block on I/O operations")
    numbers = F.regexp_extract_all(bare, F.lit(r"(?<!\w)-?\d+(?:\.\d+)?\b"), F.lit(0))
    magic = F.get(F.filter(numbers, lambda x: ~x.cast("double").isin(*UNREMARKABLE)), 0)
    warn("LR-32", magic.isNotNull(), F.concat(F.lit("Magic number detected: "), magic))
    bare_lines = lines_of(bare)
    warn("LR-33", F.exists(bare_lines, lambda x: x.rlike(r"\?.*\?") & x.rlike(":.*:")), "Ternary hell detected: multiple operators on the same line")

    def followed(xs: Column, both) -> Column:
        filled = F.filter(F.transform(xs, stripped), lambda x: x != "")
        return F.get(F.transform(F.array(filled), lambda f: F.exists(F.zip_with(f, F.slice(f, F.lit(2), F.size(f)), both), lambda x: F.coalesce(x, F.lit(False)))), 0)

    def obvious(x: Column, y: Column) -> Column:
        said = x.rlike("^(?:#|//)") & _any(F.lower(F.regexp_replace(x, r"^[/#* \t]+", "")), OBVIOUS)
        return said & (_any(y, ("++", "+=", "return")) | y.rlike(r"=\s*.*\+\s*1\b") | y.startswith("get"))

    warn("LR-34", followed(lines, obvious), "Stating the obvious comment detected")
    warn("LR-35", followed(bare_lines, lambda x, y: F.contains(x, F.lit("await")) & F.contains(y, F.lit("await"))), "Sequential awaits detected: run them in parallel if possible")
    both = F.concat(signature, F.lit("\n"), bare)
    warn("LR-36", both.rlike(rf"(?i){FLAG}\s*:\s*(bool|boolean)\b") | both.rlike(rf"{FLAG}\s*=\s*(True|False|true|false)\b"), "Boolean parameter flag detected")
    blank = stripped(docstring) == ""
    warn("LR-37", blank, "Missing docstring")
    stated = F.exists(F.split(inside(signature), ","), lambda x: stripped(x) != "")
    undocumented = stated & (F.size(docstrings.params(docstring, language)) == 0) & F.lower(language).isin(*DOCUMENTED)
    warn("LR-38", ~blank & undocumented, "Malformed docstring: signature parameters are not documented")
    return dict(sorted(out.items()))


def _once(columns: dict[str, Column], combine) -> Column:
    """What ``combine`` makes of the findings of a record, whose code without comments and strings is made once."""
    names = list(columns)
    record = F.struct(*[columns[n].alias(n) for n in names], without_comments(F.coalesce(columns["code"], F.lit(""))).alias("plain"))

    def of(r: Column) -> Column:
        return F.struct(*[r[n].alias(n) for n in (*names, "plain")], without_strings(r["plain"]).alias("bare"))

    whole = F.transform(F.transform(F.array(record), of), lambda r: combine(_findings(**{n: r[n] for n in (*names, "plain", "bare")})))
    return F.get(whole, 0)


def warnings(**columns: Column) -> Column:
    """The texts of all warnings of a record; see ``findings`` for the columns."""
    return _once(columns, lambda found: F.flatten(F.array(*found.values())))


def broken(**columns: Column) -> Column:
    """The identifiers of all rules broken, sorted."""
    return _once(columns, lambda found: F.array_compact(F.array(*[F.when(F.size(w) > 0, F.lit(rule)) for rule, w in found.items()])))


def by_record(records: DataFrame, columns: dict[str, Column], make: Callable[..., Column], name: str, also: tuple[str, ...] = ()) -> DataFrame:
    """``also``, what ``make`` (``warnings`` or ``broken``) gives as ``name``, and n: how many records are so; records that are alike are one row, read once.

    ``columns`` are those of ``findings``. The rules are many patterns a record, and copies of a file have the same records.
    """
    alike = records.select(*also, *[c.alias(f"__{n}") for n, c in columns.items()])
    alike = alike.groupBy(*alike.columns).agg(F.count("*").alias("n"))
    # Through an array and out again: a filter on what the rules give would else be one that makes it a second time.
    made = alike.select(*also, "n", F.explode(F.array(make(**{n: F.col(f"__{n}") for n in columns}))).alias(name))
    return made.select(*also, name, "n")
