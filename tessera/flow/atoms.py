"""Dataflow atoms of PHP code: what happens at which place, in the order of the text.

Strings and comments are blanked first, at equal length, so that every place in the blanked text is one in the code. Each finder is a pattern
over one of the two texts and what its matches stand for; atoms at one place keep the order of the finders.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Patterns of the language's constructs.
_HIDDEN = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\r\n]*|#[^\r\n]*|(['\"])(?:\\.|(?!\1).)*(?:\1|\Z)", re.S)
_ENTITY = re.compile(r"\b(class|interface|enum)\s+(\w+)\s*(?:extends\s+[\w\\]+)?\s*(?:implements\s+[\w\\]+(?:\s*,\s*[\w\\]+)*)?\s*\{", re.I)
_PROPERTY = re.compile(r"\b(public|private|protected|var)?\s+(?:static\s+)?(?:\??\w+\s+)?\$(\w+)\s*(?:=\s*([^;]+))?;", re.I | re.S)
_METHOD = re.compile(r"\b(?:(?:public|private|protected)\s+)?(?:static\s+)?function\s+(\w+)\s*\(", re.I)
_SCENARIO = re.compile(r"if\s*\(\s*.*?security_level.*?==\s*['\"](\w+)['\"]", re.I)
_PARAMETERS = re.compile(r"function\s+\w+\s*\(([^)]*)\)")
_SUPERGLOBAL = re.compile(r"\$_(SESSION|COOKIE|GET|POST|REQUEST|SERVER|FILES)\[['\"](\w+)['\"]\]")
_DEFINE = re.compile(r"define\s*\(\s*['\"](\w+)['\"]\s*,\s*(['\"].*?['\"]|[^,)]+)\s*\)", re.I)
_CONST = re.compile(r"\bconst\s+(\w+)\s*=\s*(['\"].*?['\"]|[^;]+);", re.I)
_GLOBAL_ARRAY = re.compile(r"(\$_(?:SESSION|CONFIG|ENV|SERVER)|\$GLOBALS)\[['\"](\w+)['\"]\]\s*=\s*(['\"].*?['\"]|[^;]+);", re.I)
_ASSIGN = re.compile(r"(?<!['\"\w\$])(\$[\w\->\[\]'\" ]+)\s*([\.\+\-\*\/]?=)\s*([^;]+);")
_INCLUDE = re.compile(r"(?<!['\"\w\$])\b(include|require)(_once)?\b\s*\(?(['\"].*?['\"]|[^;]{1,100})\)?\s*;", re.I)
_SINK = re.compile(r"(?<!['\"\w\$])\b(echo|print|query|die|header|setcookie|mysqli_query|mysqli_prepare|eval|exec|system|shell_exec)\b\s*\(?([^;)\n]{1,200})\)?", re.I)
_LOCATION = re.compile(r"Location:\s*(['\"].*?['\"]|[^'\"\s]+)", re.I)
_CALL = re.compile(
    r"(?<!['\"\w\$])(?!\b(?:if|elseif|else|switch|for|while|foreach|echo|print|die|include|require|header|setcookie|mysqli_query|mysqli_prepare|eval|exec|system|shell_exec)\b)(\w+)\s*\(([^;)\n]{0,200})\)",
    re.I,
)
_CONDITION = re.compile(r"\b(if|elseif|else if|else|switch|case|default|for|while|foreach)\b(?:\s*\(?([^{:\n]+))?")
_VARIABLE = re.compile(r"(?<!['\"\w\$])(\$[a-zA-Z_\x7f-\xff][a-zA-Z0-9_\x7f-\xff]*)")
_BRACE, _INTERRUPT = re.compile(r"[{}]"), re.compile(r"\b(break|return)\b\s*;?")
QUOTES = "'\""
#: The application whose security levels part scenarios.
MARKED = "DVWA"


@dataclass
class Atom:
    """One place of the code; which fields are set goes by the type."""

    type: str
    pos: int
    line: int = 0
    variable: str | None = None
    value: str | None = None
    operation: str | None = None
    source: str | None = None
    verb: str | None = None
    name: str | None = None
    args: str | None = None
    methods: list[str] = field(default_factory=list)
    properties: dict[str, tuple[str, str]] = field(default_factory=dict)


def blanked(code: str) -> str:
    """The code with comments and the insides of strings as blanks; line ends stay."""
    empty = lambda s: re.sub(r"[^\r\n]", " ", s)

    def hide(m: re.Match) -> str:
        quote, text = m[1], m[0]
        if not quote:
            return empty(text)
        closed = len(text) > 1 and text.endswith(quote) and m.end(1) < m.end() and not _escaped_end(text)
        return quote + empty(text[1:-1]) + quote if closed else quote + empty(text[1:])

    return _HIDDEN.sub(hide, code)


def _escaped_end(text: str) -> bool:
    """Whether the last character of a string that ran to the end is escaped."""
    head = text[:-1]
    return (len(head) - len(head.rstrip("\\"))) % 2 == 1


def entities(code: str) -> Iterator[tuple[re.Match, str]]:
    """Classes, interfaces and enums with their bodies; those that are never closed are left out."""
    for m in _ENTITY.finditer(code):
        depth = 0
        for brace in _BRACE.finditer(code, m.end() - 1):
            depth += 1 if brace[0] == "{" else -1
            if depth == 0:
                yield m, code[m.end() : brace.start()]
                break


def constants(code: str) -> dict[str, str]:
    """Constants and settings that a set-up file states, by name; of repeated names the last of its kind."""
    out = {m[1]: m[2].strip().strip(QUOTES) for p in (_DEFINE, _CONST) for m in p.finditer(code)}
    return out | {f"{m[1]}['{m[2]}']": m[3].strip().strip(QUOTES) for m in _GLOBAL_ARRAY.finditer(code)}


class _Snippet:
    def __init__(self, code: str, redirectors: frozenset[str]):
        self.code, self.blank, self.redirectors = code, blanked(code), redirectors
        self.named: set[str] = set()

    def own(self, m: re.Match, group: int) -> str:
        """What the code has where the blanked text matched."""
        return self.code[m.start(group) : m.end(group)].strip()

    def in_code(self, pattern: re.Pattern) -> Iterator[re.Match]:
        return (m for m in pattern.finditer(self.code) if self.blank[m.start()] != " ")

    def in_blank(self, pattern: re.Pattern) -> Iterator[re.Match]:
        return pattern.finditer(self.blank)

    def scenario(self) -> Iterator[Atom]:
        found = _SCENARIO.search(self.code) if MARKED in self.code else None
        if found:
            yield Atom("scenario_switch", found.start(), variable="security_level", value=found[1])

    def parameters(self) -> Iterator[Atom]:
        for m in self.in_blank(_PARAMETERS):
            for name in map(str.strip, self.code[m.start(1) : m.end(1)].split(",")):
                if name.startswith("$"):
                    yield Atom("assignment", m.start(), variable=name, operation="=", value="$_GET['external_input']")

    def superglobals(self) -> Iterator[Atom]:
        for m in self.in_code(_SUPERGLOBAL):
            yield Atom("global_state", m.start(), variable=f"$_{m[1]}['{m[2]}']", source=f"_{m[1]}")

    def definitions(self) -> Iterator[Atom]:
        for m, body in entities(self.code):
            shown = lambda p: "public" if (p[1] or "var").lower() == "var" else p[1]
            has = {p[2]: (shown(p), re.sub(r"\s+", " ", p[3].strip()) if p[3] else "null") for p in _PROPERTY.finditer(body)}
            yield Atom("symbol_definition", m.start(), variable=m[2], name=m[1].capitalize(), properties=has, methods=_METHOD.findall(body))
            for name in has:
                yield Atom("global_state", m.start(), variable=f"{m[2]}::${name}", source="internal")

    def constants(self) -> Iterator[Atom]:
        for pattern in (_DEFINE, _CONST):
            for m in self.in_code(pattern):
                yield Atom("constant", m.start(), variable=m[1], value=m[2].strip().strip(QUOTES))

    def assignments(self) -> Iterator[Atom]:
        for m in self.in_blank(_ASSIGN):
            yield Atom("assignment", m.start(), variable=self.own(m, 1), operation=m[2], value=self.own(m, 3))

    def includes(self) -> Iterator[Atom]:
        for m in self.in_blank(_INCLUDE):
            path = self.own(m, 3)
            if len(path) >= 2 and not re.search(r"[<>\n]|  ", path):
                yield Atom("synthesized_call", m.start(), verb=m[1], value=path)

    def sinks(self) -> Iterator[Atom]:
        for m in self.in_blank(_SINK):
            sink, args = m[1].lower(), self.own(m, 2)
            to = _LOCATION.search(args) if sink == "header" else None
            if to:
                yield Atom("synthesized_call", m.start(), verb="redirect", value=to[1].strip().strip(QUOTES))
            yield Atom("sink", m.start(), name=sink, args=args)

    def calls(self) -> Iterator[Atom]:
        for m in self.in_blank(_CALL):
            args = self.own(m, 2)
            if m[1] in self.redirectors or "redirect" in m[1].lower():
                yield Atom("synthesized_call", m.start(), verb="redirect", value=args.strip(QUOTES))
            else:
                yield Atom("call", m.start(), name=m[1], args=args)

    def conditions(self) -> Iterator[Atom]:
        for m in self.in_blank(_CONDITION):
            text = self.own(m, 2) if m[2] else ""
            for end in ")", ":":
                text = text[:-1].strip() if text.endswith(end) else text
            text = text.replace("\n", " ").replace("\r", "")
            text = text if len(text) <= 150 else text[:147] + "..."
            yield Atom("condition", m.start(), verb=m[1], value=text.strip(": ") if m[1] in ("case", "default") else text)
            if m[1] == "switch" and text.startswith("$"):
                yield Atom("usage", m.start(), variable=text)

    def usages(self) -> Iterator[Atom]:
        for m in self.in_blank(_VARIABLE):
            if m[1] not in self.named:
                yield Atom("usage", m.start(), variable=m[1])

    def braces(self) -> Iterator[Atom]:
        for m in self.in_blank(_BRACE):
            yield Atom("delimiter", m.start(), value=m[0])

    def interrupts(self) -> Iterator[Atom]:
        for m in self.in_blank(_INTERRUPT):
            yield Atom("interrupt", m.start(), value=m[1])


_FINDERS: tuple[Callable[[_Snippet], Iterator[Atom]], ...] = (
    _Snippet.scenario, _Snippet.parameters, _Snippet.superglobals, _Snippet.definitions, _Snippet.constants, _Snippet.assignments, _Snippet.includes,
    _Snippet.sinks, _Snippet.calls, _Snippet.conditions, _Snippet.usages, _Snippet.braces, _Snippet.interrupts,
)


def atoms_of(code: str, redirectors: frozenset[str] = frozenset()) -> list[Atom]:
    """All atoms of a PHP text by place. A variable that is only used is an atom at its first use: then it is known."""
    snippet, out = _Snippet(code, redirectors), []
    for find in _FINDERS:
        for atom in find(snippet):
            out.append(atom)
            if atom.variable is not None:
                snippet.named.add(atom.variable)
    starts = [0, *accumulate(map(len, code.splitlines(keepends=True)))]
    for atom in out:
        atom.line = bisect_right(starts, atom.pos)
    return sorted(out, key=lambda a: a.pos)


COLUMNS = ("type", "pos", "line", "variable", "value", "operation", "source", "verb", "name", "args")
#: Texts whose atoms a task remembers (copies of a file are read once), and atoms that go out together.
_REMEMBERED, _TOGETHER = 256, 20_000


def _fields(found: list[Atom]) -> pa.Table:
    return pa.table({c: pa.array([getattr(a, c) for a in found], pa.int32() if c in ("pos", "line") else pa.string()) for c in COLUMNS})


def atoms(symbols: DataFrame, symbol: str = "symbol", code: str = "code", language: str = "language", redirectors: tuple[str, ...] = ()) -> DataFrame:
    """symbol, ordinal and the fields of each atom of each row whose language is php; other languages and null code have none.

    Finding places needs positions of all matches, which SQL functions don't give: Arrow batches, without a shuffle.
    """
    known = frozenset(redirectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lru_cache(_REMEMBERED)(lambda text: _fields(atoms_of(text, known)))
        for batch in batches:
            texts = batch.column("code").to_pylist()
            begin = 0
            while begin < len(texts):  # what goes out at once is bounded, however many atoms a text has
                tables, end, room = [], begin, _TOGETHER
                while end < len(texts) and room > 0:
                    tables.append(found(texts[end]))
                    room -= len(tables[-1])
                    end += 1
                each = np.fromiter(map(len, tables), np.int64, len(tables))
                own = batch.column("symbol").take(pa.array(np.repeat(np.arange(begin, end), each)))
                ordinal = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                whole = pa.concat_tables(tables).combine_chunks()
                columns = {c: pa.concat_arrays(whole[c].chunks) if whole.num_rows else pa.array([], whole.schema.field(c).type) for c in COLUMNS}
                yield pa.RecordBatch.from_pydict({"symbol": own, "ordinal": pa.array(ordinal, pa.int32()), **columns})
                begin = end

    rows = symbols.where((symbols[language] == "php") & symbols[code].isNotNull()).select(symbols[symbol].alias("symbol"), symbols[code].cast("string").alias("code"))
    kind = rows.schema["symbol"].dataType.simpleString()
    return rows.mapInArrow(run, f"symbol {kind}, ordinal int, " + ", ".join(f"{c} {'int' if c in ('pos', 'line') else 'string'}" for c in COLUMNS))


def made_up_states(found: DataFrame) -> DataFrame:
    """src, dst, ordinal, condition: edges from a symbol to the states that its includes, redirects and sinks stand for (see ``atoms``), as a behaviour map takes them."""
    made = found.where(F.col("type").isin("synthesized_call", "sink"))
    said = F.when(F.col("type") == "sink", F.concat(F.lit("["), "name", F.lit("] "), F.coalesce("args", F.lit("")))).when(
        F.col("verb") == "redirect", F.concat(F.lit("Redirect: "), "value")
    ).otherwise(F.concat(F.lit("["), "verb", F.lit("] "), "value"))
    return made.select(F.col("symbol").cast("string").alias("src"), said.alias("dst"), (F.lit(1 << 20) + F.col("ordinal")).alias("ordinal"), F.lit(None).cast("string").alias("condition"))
