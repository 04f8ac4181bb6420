"""Parameters, returns and rules that docstrings state, by language, as column expressions.

A null or empty docstring, or a language without a parser, gives empty arrays and empty fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# How each language marks a parameter, and the groups that hold name, type (0: none) and description.
PARAMS = {
    "javascript": (r"@param\s+(?:\{([^}]*)\}\s+)?(\w+)\s+(.*)", 2, 1, 3),
    "php": (r"@param\s+(?:\{([^}]*)\}\s+)?\$(\w+)\s+(.*)", 2, 1, 3),
    "solidity": (r"@param\s+(\w+)\s+(.*)", 1, 0, 2),
    "cpp": (r"(?:@|\\)param(?:\s*\[[^\]]*\])?\s+(\w+)\s+(.*)", 1, 0, 2),
    "rust": (r"\*\s+`(\w+)`\s+-\s+(.*)", 1, 0, 2),
    "python": (r"^\s+(\w+)\s*(?:\(([^)]*)\))?\s*:\s*(.+)$", 1, 2, 3),
}
# What a language returns; groups of type and description.
RETURNS = {
    "javascript": (r"@returns?\s+(?:\{([^}]*)\}\s+)?(.*)", 1, 2),
    "php": (r"@returns?\s+(?:\{([^}]*)\}\s+)?(.*)", 1, 2),
    "solidity": (r"@return\s+(?:(\w+)\s+)?(.*)", 0, 2),
    "cpp": (r"(?:@|\\)returns?\s+(.*)", 0, 1),
}
# The styles of a Go line, the first that fits counts.
GO_PARAMS = ((r"@param\s+\{([^}]+)\}\s+(\w+)\s+(.*)", 2, 1, 3), (r"@param\s+(\w+)\s+(\w+)\s+(.*)", 1, 2, 3), (r"@param\s+(\w+)\s+(.*)", 1, 0, 2))
GO_RETURNS = ((r"@returns?\s+\{([^}]+)\}\s+(.*)", 1, 2), (r"@returns?\s+(\w+)\s+(.*)", 1, 2), (r"@returns?\s+(.*)", 0, 1))
# Words that make a line of more than 10 characters a rule.
RULE_WORDS = "must|should|ensure|valid|check|verify|only"
CPP_RULE_WORDS = RULE_WORDS + "|calculation|multiply|logic"

_FLAGS = "(?idU)"
_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
PARAM_TYPE, RETURN_TYPE = "array<struct<name:string,type:string,description:string>>", "struct<type:string,description:string>"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def _bare(x: Column) -> Column:
    """A line without the comment marks around it."""
    return F.regexp_replace(_strip(x), r"^[/* ]+|[*/ ]+$", "")


def _lines(doc: Column) -> Column:
    return F.split(doc, _LINE_END)


def _group(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(x, _FLAGS + pattern, group) if group else F.lit("")


def _param(name: Column, kind: Column, description: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("type"), _strip(description).alias("description"))


def _returned(kind: Column, description: Column) -> Column:
    return F.struct(kind.alias("type"), description.alias("description"))


def _matches(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(_FLAGS + pattern), F.lit(0))


def _marked(doc: Column, language: str) -> Column:
    """Every match of the language's parameter pattern; each match is read again for its groups."""
    pattern, name, kind, description = PARAMS[language]
    sign = F.lit("$" if language == "php" else "")
    return F.transform(
        _matches(doc, pattern),
        lambda m: _param(F.concat(sign, _group(m, pattern, name)), _group(m, pattern, kind), _group(m, pattern, description)),
    )


def _rule_lines(lines: Column, words: str = RULE_WORDS) -> Column:
    return F.filter(lines, lambda x: (F.length(x) > 10) & F.lower(x).rlike(words))


def _sections(lines: Column, header: Callable[[Column], Column], restart: bool) -> Column:
    """(section, line) of each line, by a fold; ``header`` names a line's new section or is null.

    With ``restart`` a header drops what its section had and is no line itself; else it is the section's next line.
    """
    state = "struct<now:string,kept:array<struct<section:string,line:string>>>"

    def step(s: Column, line: Column) -> Column:
        name = header(line)
        now = F.coalesce(name, s["now"])
        added = F.array_append(s["kept"], F.struct(now.alias("section"), line.alias("line")))
        if restart:
            added = F.when(name.isNull(), added).otherwise(F.filter(s["kept"], lambda k: k["section"] != name))
        return F.struct(now.alias("now"), added.alias("kept")).cast(state)

    start = F.struct(F.lit("_main").alias("now"), F.array().alias("kept")).cast(state)
    return F.aggregate(lines, start, step)["kept"]


def _of(kept: Column, section: str) -> Column:
    return F.transform(F.filter(kept, lambda k: k["section"] == section), lambda k: k["line"])


def _first_filled(*arrays: Column) -> Column:
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays], F.array().cast("array<string>"))


def _python(doc: Column) -> Column:
    """Sections of a docstring; a line of one word that ends with a colon opens one."""
    filled = F.filter(_lines(doc), lambda x: _strip(x) != "")

    def header(x: Column) -> Column:
        s = _strip(x)
        return F.when(s.endswith(":") & ~s.contains(" "), F.lower(F.substring(s, F.lit(1), F.length(s) - 1)))

    return _sections(filled, header, restart=True)


def _php(doc: Column) -> Column:
    filled = F.filter(F.transform(_lines(doc), _bare), lambda x: x != "")
    return _sections(filled, lambda x: F.when(x.startswith("@"), F.lower(F.regexp_extract(x, "^@([^ ]*)", 1))), restart=False)


def _go(doc: Column) -> Column:
    bare = F.transform(_lines(doc), lambda x: _strip(F.regexp_replace(_strip(x), "^/+", "")))
    return F.filter(bare, lambda x: x != "")


def _rust_block(doc: Column, title: str) -> Column:
    return F.regexp_extract(doc, rf"(?iU)#\s*{title}\s*\n([\s\S]*?)(?=#\s|\z)", 1)


def _by_language(language: Column, cases: dict[str, Column], otherwise: Column) -> Column:
    name, out = F.lower(language), otherwise
    for key, value in cases.items():
        out = F.when(name == key, value).otherwise(out)
    return out


def params(doc: Column, language: Column) -> Column:
    """array of (name, type, description), in the order of the docstring."""
    kept = _python(doc)
    pattern, *at = PARAMS["python"]
    lines = F.filter(_first_filled(*[_of(kept, s) for s in ("args", "arguments", "parameters")]), lambda x: x.rlike("(?dU)" + pattern))
    python = F.transform(lines, lambda x: _param(*[_group(x, pattern, g) for g in at]))

    def go_line(x: Column) -> Column:
        return F.coalesce(*[F.when(x.rlike(_FLAGS + p), _param(_group(x, p, n), _group(x, p, t), _group(x, p, d))) for p, n, t, d in GO_PARAMS])

    cases = {x: _marked(doc, x) for x in ("javascript", "php", "solidity", "cpp")}
    cases |= {
        "typescript": cases["javascript"], "python": python, "rust": _marked(_rust_block(doc, "Arguments"), "rust"),
        "go": F.filter(F.transform(_go(doc), go_line), lambda p: p.isNotNull()),
    }
    none = F.array().cast(PARAM_TYPE)
    return F.coalesce(_by_language(language, {k: v.cast(PARAM_TYPE) for k, v in cases.items()}, none), none)


def returns(doc: Column, language: Column) -> Column:
    """(type, description) of the first statement of what is returned."""
    kept = _python(doc)
    lines = F.transform(_first_filled(_of(kept, "returns"), _of(kept, "return")), _strip)
    first, rest = F.get(lines, 0), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), " ")
    python = (
        F.when(F.size(lines) == 0, _returned(F.lit(""), F.lit("")))
        .when(first.contains(":"), _returned(_strip(F.substring_index(first, ":", 1)), F.concat(_strip(F.regexp_extract(first, ":(.*)$", 1)), F.lit(" "), rest)))
        .when(~first.rlike(r"(?U)\s"), _returned(first, rest))
        .otherwise(_returned(F.lit(""), F.array_join(lines, " ")))
    )
    line = F.get(F.filter(_go(doc), lambda x: x.rlike(_FLAGS + GO_RETURNS[-1][0])), 0)
    go = F.coalesce(*[F.when(line.rlike(_FLAGS + p), _returned(_group(line, p, t), _strip(_group(line, p, d)))) for p, t, d in GO_RETURNS])
    cases = {k: _returned(_group(doc, p, t), _strip(_group(doc, p, d))) for k, (p, t, d) in RETURNS.items()}
    cases |= {"typescript": cases["javascript"], "python": python, "go": go, "rust": _returned(F.lit(""), _strip(_rust_block(doc, "Returns")))}
    none = _returned(F.lit(""), F.lit("")).cast(RETURN_TYPE)
    cases = {k: F.when(doc.isNotNull(), v.cast(RETURN_TYPE)) for k, v in cases.items()}
    return F.coalesce(_by_language(language, cases, none), none)


def rules(doc: Column, language: Column) -> Column:
    """Sentences of the docstring that state a rule."""
    bare = F.transform(_lines(doc), _bare)
    stripped = lambda a: F.transform(a, _strip)
    tagged = lambda p: stripped(F.regexp_extract_all(doc, F.lit(_FLAGS + p), F.lit(1)))
    php = _php(doc)
    brief = F.slice(tagged(r"(?:@|\\)brief\s+(.*)"), 1, 1)
    cpp = _rule_lines(F.transform(F.filter(_lines(doc), lambda x: ~x.contains("@brief")), _bare), CPP_RULE_WORDS)
    javascript = _rule_lines(bare)
    cases = {
        "python": _rule_lines(stripped(_of(_python(doc), "_main"))),
        "javascript": javascript,
        "typescript": javascript,
        "solidity": F.concat(tagged(r"@notice\s+(.+)"), tagged(r"@dev\s+(.+)")),
        "go": F.filter(F.regexp_extract_all(doc, F.lit(r"(?mdU)^//\s*(.+)$"), F.lit(1)), lambda x: F.length(x) > 5),
        "rust": _rule_lines(stripped(F.regexp_extract_all(doc, F.lit(r"(?mdU)^///?!?\s*(.*)$"), F.lit(1)))),
        "cpp": F.concat(brief, cpp),
        "php": F.concat(F.transform(_of(php, "rule"), lambda x: _strip(F.replace(x, F.lit("@rule"), F.lit("")))), _rule_lines(_of(php, "_main"))),
    }
    none = F.array().cast("array<string>")
    return F.coalesce(_by_language(language, cases, none), none)


def genome(name: Column, signature: Column, doc: Column, stated: Column) -> Column:
    """One line for a symbol: name(signature) — docstring without comment marks, Rules: rules joined by semicolons."""
    sig = F.when(F.coalesce(signature, F.lit("")) == "", "").when(signature.startswith("("), signature).otherwise(F.concat(F.lit("("), signature, F.lit(")")))
    text = F.when(_strip(F.coalesce(doc, F.lit(""))) == "", "").otherwise(F.concat(F.lit(" — "), _strip(F.regexp_replace(doc, r"[*/]+", ""))))
    said = F.when(F.coalesce(F.size(stated), F.lit(0)) > 0, F.concat(F.lit(" Rules: "), F.array_join(stated, "; "))).otherwise("")
    return F.concat(F.coalesce(name, F.lit("unknown")), sig, text, said)
