"""Pages of a code base in Markdown, as rows of path and content, and their way into a folder.

Each page is one row: of a symbol, a file, a behaviour (with its states and transitions beside it in JSON), an archetype. Texts that are null or empty leave
their section out. Rows without the name that a page would have give no page.
"""

from __future__ import annotations

import posixpath
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.session import checkpointed


def _path(folder: str, name: str, suffix: str = ".md") -> Column:
    return F.concat(F.lit(f"{folder}/"), text.safe_name(F.col(name)), F.lit(suffix))


def _link(folder: str, name: Column) -> Column:
    return F.concat(F.lit(f"[[{folder}/"), text.safe_name(name), F.lit("\\|"), text.short_name(name), F.lit("]]"))


def _lines(items: Column) -> Column:
    """An array as a list; a null item is left out, as is an empty or null array."""
    return F.coalesce(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit(""))


def _section(title: str, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n")))


def _page(heading: Column, *sections: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("# "), heading, F.lit("\n")), *sections).alias("content")


def _number(c: str, default: float) -> Column:
    return F.format_string("%.2f", F.coalesce(F.col(c), F.lit(default)))


def _fact(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"- **{name}**: "), value)


def _facts(*facts: Column) -> Column:
    return F.concat_ws("\n", *facts)


def symbol_pages(symbols: DataFrame, adjacency: DataFrame, findings: DataFrame) -> DataFrame:
    """path, content: a page for each name of ``symbols`` (parsed, with mass, energy, archetype); of rows that repeat a name, one.

    ``adjacency`` has node, callers, callees, ``findings`` cwe, title, function, severity. A caller is listed once on a page, however often it calls.
    """
    found = findings.groupBy(F.trim("function").alias("name")).agg(F.sort_array(F.collect_set(F.concat_ws(" ", "cwe", "title", F.concat(F.lit("("), "severity", F.lit(")"))))).alias("__findings"))
    near = adjacency.select(F.col("node").alias("name"), "callers", "callees")
    s = symbols.where("name is not null").dropDuplicates(["name"]).join(near, "name", "left").join(found, "name", "left")
    called = lambda c: _lines(F.transform(F.array_distinct(c), lambda x: _link("symbols", x)))
    parameter = lambda p: F.concat_ws(" ", F.concat(F.lit("`"), p["name"], F.lit("`")), p["type"], p["description"])
    return s.select(
        _path("symbols", "name").alias("path"),
        _page(
            F.concat(F.coalesce("kind", F.lit("Symbol")), F.lit(": "), text.short_name(F.col("name"))),
            _section("Context", _facts(_fact("File", F.col("file")), _fact("Line", F.col("line").cast("string")), _fact("Archetype", F.coalesce("archetype", F.lit("generic"))), _fact("Mass", _number("mass", 1.0)), _fact("Energy", _number("energy", 0.0)))),
            _section("Signature", F.concat(F.lit("`"), F.nullif(F.col("signature"), F.lit("")), F.lit("`"))),
            _section("Documentation", F.col("docstring")),
            _section("Parameters", _lines(F.transform("params", parameter))),
            _section("Rules", _lines(F.col("rules"))),
            _section("Warnings", _lines(F.col("warnings"))),
            _section("Callers", called("callers")),
            _section("Callees", called("callees")),
            _section("Findings", _lines(F.col("__findings"))),
        ),
    )


def file_pages(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, content: a page for each file of ``files`` (file, symbols, mass, energy, archetypes, lines, bytes) with links to its symbols by name."""
    own = symbols.where("name is not null").groupBy("file").agg(F.sort_array(F.collect_set("name")).alias("__names"))
    f = files.where("file is not null").join(own, "file", "left")
    count = lambda c: F.col(c).cast("string")
    return f.select(
        _path("files", "file").alias("path"),
        _page(
            F.concat(F.lit("File: "), "file"),
            _section("Metadata", _facts(_fact("Symbols", count("symbols")), _fact("Lines", count("lines")), _fact("Bytes", count("bytes")), _fact("Mass", _number("mass", 0.0)), _fact("Mean energy", _number("energy", 0.0)), _fact("Archetypes", F.col("archetypes")))),
            _section("Symbols", _lines(F.transform("__names", lambda x: _link("symbols", x)))),
        ),
    )


def behaviour_pages(behaviours: DataFrame) -> DataFrame:
    """path, content of each start's map (start, step, src, dst, label, is_macro): a state diagram, and beside it its states and transitions as JSON, in order of steps.

    A map is as long as the bound on its states allows.
    """
    steps = F.sort_array(F.collect_list(F.struct("step", "src", "dst", "label")))
    maps = behaviours.where("start is not null").groupBy("start").agg(steps.alias("transitions"), F.bool_or("is_macro").alias("is_macro"))
    maps = maps.withColumn("states", F.array_distinct(F.concat(F.array("start"), F.transform("transitions", lambda t: t["src"]), F.transform("transitions", lambda t: t["dst"]))))
    number = lambda x: F.concat(F.lit("s"), F.array_position("states", x).cast("string"))
    shown = lambda x: F.replace(F.regexp_replace(x, r"\s+", " "), F.lit('"'), F.lit("'"))
    named = F.transform("states", lambda x: F.concat(F.lit('    state "'), shown(x), F.lit('" as '), number(x)))
    moves = F.transform("transitions", lambda t: F.concat(F.lit("    "), number(t["src"]), F.lit(" --> "), number(t["dst"]), F.lit(": "), shown(t["label"])))
    diagram = F.concat(F.lit("```mermaid\nstateDiagram-v2\n"), F.array_join(F.concat(named, moves), "\n"), F.lit("\n```"))
    title = F.concat(F.lit("Behaviour: "), "start", F.when(F.col("is_macro"), " (macro map)").otherwise(""))
    page = maps.select(_path("behaviors", "start").alias("path"), _page(title, _section("States", diagram), _section("Participating symbols", _lines(F.transform(F.filter("states", lambda x: ~F.startswith(x, F.lit("["))), lambda x: _link("symbols", x))))))
    return page.union(maps.select(_path("behaviors", "start", ".json"), F.to_json(F.struct("start", "is_macro", "states", "transitions"))))


def narratives(symbols: DataFrame, top: int = 10) -> DataFrame:
    """path, content: a page for each archetype of symbols (name, mass, energy, archetype): how many, their mass, and the ``top`` by mass, then name."""
    s = symbols.where("name is not null").select("name", F.coalesce("archetype", F.lit("generic")).alias("archetype"), F.coalesce("mass", F.lit(1.0)).alias("mass"), F.coalesce("energy", F.lit(0.0)).alias("energy"))
    whole = s.groupBy("archetype").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))
    line = F.format_string("%s (mass %.2f, energy %.2f)", _link("symbols", F.col("name")), "mass", "energy")
    first = s.withColumn("rank", F.row_number().over(W.partitionBy("archetype").orderBy(F.desc("mass"), "name", "energy"))).where(F.col("rank") <= top)
    key = first.groupBy("archetype").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("__top"))
    said = F.format_string("%d symbols with a mass of %.2f together.", "n", "mass")
    return whole.join(key, "archetype").select(_path("narratives", "archetype").alias("path"), _page(F.concat(F.lit("Subsystem: "), "archetype"), said, _section("Key symbols", _lines(F.transform("__top", lambda x: x["line"])))))


def warning_pages(records: DataFrame) -> DataFrame:
    """path, content: a table of warnings for each file of records (name, file, warnings as one text); a file each, as one page of all would be one row."""
    row = F.concat(F.lit("| "), _link("symbols", F.col("name")), F.lit(" | "), text.table_cell(F.col("warnings"), 2_000), F.lit(" |"))
    per = records.where("name is not null").groupBy(F.coalesce("file", F.lit("unknown")).alias("file")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return per.select(_path("warnings", "file").alias("path"), _page(F.concat(F.lit("Warnings: "), "file"), F.concat(F.lit("| Symbol | Warnings |\n|:---|:---|\n"), F.array_join("rows", "\n"))))


def library_pages(tables: dict[str, DataFrame]) -> DataFrame:
    """All pages of the tables that ``api.library`` gives."""
    t = tables
    made = [symbol_pages(t["symbols"], t["adjacency"], t["findings"]), file_pages(t["files"], t["symbols"]), behaviour_pages(t["behaviours"]), narratives(t["symbols"]), warning_pages(t["warnings"])]
    return reduce(DataFrame.union, made)


def contained(path: Column) -> Column:
    """``path`` itself; an error where it is null, absolute, of another store, or leads out of its folder."""
    out = path.isNull() | path.rlike(r"^[/\\]|^[A-Za-z][A-Za-z0-9+.-]*:|(^|[/\\])\.\.([/\\]|$)")
    return F.when(out, F.raise_error(F.concat(F.lit("path leads out of its folder: "), F.coalesce(path, F.lit("null"))))).otherwise(path)


def write(pages: DataFrame, folder: str) -> int:
    """Write each page to its path below ``folder``, in any store that Spark writes, and give their number; all paths are checked first.

    Pages come to the driver one partition at a time. For very many, write the table itself.
    """
    spark = pages.sparkSession
    # All pages are made once, and an error comes before anything is written.
    checked = checkpointed(pages.select(contained(F.col("path")).alias("path"), F.coalesce("content", F.lit("")).alias("content")))
    hadoop, n = spark._jvm.org.apache.hadoop.fs, 0
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in checked.toLocalIterator():
        out = fs.create(hadoop.Path(posixpath.join(folder, r["path"])), True)
        try:
            out.write(bytearray(r["content"].encode()))
        finally:
            out.close()
        n += 1
    return n
