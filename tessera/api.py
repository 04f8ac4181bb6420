"""One function for each thing a user does with a code base: tables in, tables out.

Symbols are what ``readers.symbols`` gives: name, file, line, signature, docstring, language, code, complexity, side_effects, exported, labels, and the rest
of ``readers.FIELDS``; calls have src, dst and ordinal; files path and content.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.flow import atoms, systemic, taint
from tessera.functions import docstrings, lint, scores, text
from tessera.operators import beliefs, graph, pages, relational, reports, scans, simulation, traversal, vectors
from tessera.session import checkpointed
from tessera.sources import entrypoints as entries
from tessera.sources import readers
from tessera.streaming import jobs

#: Any function from a text to an array of numbers; this one needs no model.
Embedder = Callable[[Column], Column]
EMBED: Embedder = vectors.hashed_embedding
#: Symbols that an audit looks at.
AUDITED = 100


def parsed(symbols: DataFrame) -> DataFrame:
    """``symbols`` with kind, language, params, returns, rules, warnings and genome of each record."""
    language = F.coalesce("language", text.language_of(F.coalesce("file", F.lit(""))))
    s = symbols.withColumns({"language": language, "kind": text.kind_of(F.col("labels"))})
    of = {f.__name__: f(F.coalesce("docstring", F.lit("")), F.col("language")) for f in (docstrings.params, docstrings.returns, docstrings.rules)}
    record = {"code": F.col("code"), "name": text.short_name(F.col("name")), "signature": F.col("signature"), "docstring": F.col("docstring"), "path": F.col("file"), "kind": F.col("kind"), "language": F.col("language")}
    s = s.withColumns(of | {"warnings": lint.warnings(**record)})
    return s.withColumn("genome", docstrings.genome(F.col("name"), F.coalesce("signature", F.lit("")), F.coalesce("docstring", F.lit("")), F.col("rules")))


def _nodes(symbols: DataFrame, embed: Embedder) -> DataFrame:
    s = parsed(symbols).where("name is not null").dropDuplicates(["name"])
    return checkpointed(s.select(F.col("name").alias("id"), embed(F.col("genome")).alias("vector"), scores.mass(F.col("complexity"), F.col("side_effects"), F.col("exported")).alias("mass")))


def _scored(symbols: DataFrame, embed: Embedder, steps: int) -> DataFrame:
    n = _nodes(symbols, embed)
    numbered = checkpointed(n.withColumn("number", F.xxhash64("id")))
    at = simulation.simulate(n, steps).select("id", "x", "y")
    board = vectors.scoreboard(numbered.join(at, "id").select(F.col("number").alias("id"), "vector", "mass", "x", "y"))
    return board.withColumnRenamed("id", "number").join(numbered.select("number", F.col("id").alias("name")), "number").drop("number")


def score(symbols: DataFrame, top: int = 20, embed: Embedder = EMBED, steps: int = 100) -> DataFrame:
    """The first ``top`` symbols by score with rank, mass, energy, centrality, score and archetype."""
    return reports.ranked(_scored(symbols, embed, steps), [F.desc("score"), F.col("name")], top)


def calibrate(symbols: DataFrame, embed: Embedder = EMBED) -> DataFrame:
    """The grid of constants with the pair that spreads scores best; fewer than five symbols give no row."""
    return simulation.calibrate(_nodes(symbols, embed))


def entangled(symbols: DataFrame, name: str, embed: Embedder = EMBED) -> DataFrame:
    """name, force of symbols that a symbol attracts by more than 0.5, strongest first."""
    n = _nodes(symbols, embed).withColumn("number", F.xxhash64("id"))
    rows = n.select(F.col("number").alias("id"), "vector", "mass")
    found = vectors.entangled(rows, rows.where(F.col("id") == F.xxhash64(F.lit(name))))
    return found.join(n.select(F.col("number"), F.col("id").alias("name")), F.col("id") == F.col("number")).select("name", "force").orderBy(F.desc("force"), "name")


def search(symbols: DataFrame, query: str, k: int = 10, embed: Embedder = EMBED) -> DataFrame:
    """name, similarity, file, line of the symbols that mean most what the query says."""
    s = parsed(symbols)
    asked = s.sparkSession.range(1).select(embed(F.lit(query)).alias("__q"))  # one row
    close = scores.cosine(embed(F.col("genome")), F.col("__q"))
    return s.join(F.broadcast(asked), F.lit(True)).select("name", F.round(close, 6).alias("similarity"), "file", "line").orderBy(F.desc("similarity"), "name", "file").limit(k)


def dependencies(symbols: DataFrame) -> DataFrame:
    """file, name, dep_type, target."""
    return readers.dependencies(symbols).select(F.coalesce(F.nullif(F.col("file"), F.lit("")), F.lit("unknown")).alias("file"), "name", "dep_type", "target")


def rules(symbols: DataFrame, top: int | None = None) -> DataFrame:
    """category, description, source_function, confidence of the rules that records state; the ``top`` surest, or all."""
    found = parsed(symbols).select(F.inline(text.rules_of(F.col("name"), F.col("rules"), F.col("docstring"), F.col("code"))))
    return found if top is None else found.orderBy(F.desc("confidence"), "source_function", "category", "description").limit(top)


def entrypoints(files: DataFrame) -> DataFrame:
    return entries.entrypoints(files)


def projects(symbols: DataFrame) -> DataFrame:
    return readers.projects(symbols)


def diff(versions: DataFrame, head: str, base: str, embed: Embedder = EMBED, least: float = 0.25) -> DataFrame:
    """path, change (added, deleted, drifted), distance, meaning between two branches of a table of versions (branch, path, content); code files only drift."""
    new, old = readers.snapshot(versions, head), readers.snapshot(versions, base)
    both = relational.snapshot_diff(old, new, "path", "content").where("change in ('added', 'deleted')")
    first = F.row_number().over(W.partitionBy("change").orderBy("path")) <= 15
    both = both.select("path", "change", F.lit(None).cast("double").alias("distance"), F.when((F.col("change") == "added") & first, text.meaning(F.col("new"))).alias("meaning"))
    moved = vectors.drifted(old.where(text.is_code(F.col("path"))), new.where(text.is_code(F.col("path"))), embed, least)
    return both.union(moved.select("path", F.lit("drifted"), "distance", F.lit(None).cast("string"))).orderBy(F.desc_nulls_last("distance"), "change", "path")


def audit(symbols: DataFrame, calls: DataFrame, files: DataFrame, embed: Embedder = EMBED, top: int = AUDITED, steps: int = 30) -> dict[str, DataFrame]:
    """findings and systemic: the scans of the ``top`` symbols by score, and tainted flows from the entry points through all calls.

    Dataflow comes first, so that scans see flows and warnings.
    """
    s = parsed(symbols).withColumn("seq", F.xxhash64("name", "file"))
    settings = {r["name"]: r["value"] for r in constants(files).collect()}  # what set-up files state
    flows = checkpointed(taint.analysed(s, "name", signature="signature", constants=settings))
    chosen = reports.ranked(_scored(symbols, embed, steps), [F.desc("score"), F.col("name")], top).select("name", "score", F.col("mass").alias("weight"))
    best = checkpointed(s.drop("mass").join(F.broadcast(chosen), "name").withColumnRenamed("weight", "mass"))  # top rows
    tainted = flows.join(best.select(F.col("name").alias("symbol")).distinct(), "symbol").select(F.col("symbol").alias("function"), F.inline("flows")).withColumn("seq", F.col("line"))
    warned = best.select("name", F.coalesce("file", F.lit("unknown")).alias("file"), F.explode("warnings").alias("warning"))
    found = scans.all_scans(best, rules(symbols), tainted.select("function", "file", "line", "variable", "sink", "state", "seq"), warned)
    starts = reports.entry_symbols(entries.entrypoints(files), s.select("name", "file", "seq")).select(F.col("symbol").alias("start"))
    return {"findings": found, "systemic": systemic.trace(flows, calls, starts)}


def constants(files: DataFrame) -> DataFrame:
    """name, value, origin, kind of constants in PHP set-up files and of settings in .env files; of repeated names the last by file."""
    env = readers.settings(files).withColumn("kind", F.lit("env"))
    php = entries.setup_files(files).join(files, "path").where(F.lower("path").rlike(r"\.php(\.dist)?$"))
    spark, rows = files.sparkSession, []
    for r in php.toLocalIterator():  # set-up files, one at a time
        rows += [(name, value, r["path"], "constant") for name, value in atoms.constants(r["content"] or "").items()]
    stated = spark.createDataFrame(rows, "name string, value string, origin string, kind string")
    return relational.latest(stated, ["name"], ["origin"]).select("name", "value", "origin", "kind").unionByName(env)


def watch(changes: DataFrame, rescore: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = "5 minutes"):
    return jobs.watch(changes, rescore, checkpoint, interval)


def brain(observations: DataFrame, symbol: str, order: list[str]) -> DataFrame:
    """What the observations (kind, weight, trust) say of each symbol."""
    return beliefs.context(beliefs.collapse(beliefs.fold(observations, symbol, "kind", "weight", "trust", order)), symbol)


def sleep(observations: DataFrame, symbol: str, order: list[str]) -> DataFrame:
    return beliefs.sleep_cycle(beliefs.fold(observations, symbol, "kind", "weight", "trust", order))


def library(symbols: DataFrame, calls: DataFrame, files: DataFrame, embed: Embedder = EMBED) -> dict[str, DataFrame]:
    """The tables behind a code base's pages: symbols, files, warnings, settings, adjacency, findings, systemic, coverage, gates, zones, behaviours, archetypes, hotspots."""
    s = parsed(symbols).withColumn("seq", F.xxhash64("name", "file"))
    out = audit(symbols, calls, files, embed, top=1_000_000)
    board = checkpointed(_scored(symbols, embed, 30))
    flows = checkpointed(taint.analysed(s, "name"))
    states = taint.variable_states(flows)
    sensitive = reports.gate_candidates(states)
    inward = calls.join(sensitive.select(F.col("symbol").alias("dst")), "dst", "left_semi")
    gates = graph.gates(inward, F.lit(True))
    known = s.drop("mass", "energy", "archetype").join(board.select("name", "mass", "energy", "archetype"), "name", "left")
    edges = calls.withColumn("condition", F.lit(None).cast("string")).select("src", "dst", "ordinal", "condition")
    every = reduce(DataFrame.unionByName, [edges, atoms.made_up_states(atoms.atoms(s, "name"))])
    starts = reports.entry_symbols(entries.entrypoints(files), s.select("name", "file", "seq")).select(F.col("symbol").alias("start"))
    return out | {
        "symbols": known, "files": reports.file_report(known, files), "warnings": reports.warnings_index(s), "settings": reports.prerequisites(constants(files)), "adjacency": reports.adjacency(calls),
        "coverage": reports.coverage(out["findings"]), "gates": gates, "zones": reports.zones(s, gates, calls), "behaviours": traversal.behaviour(every, starts, s.select(F.col("name").alias("node"), "file")),
        "archetypes": reports.ranked(board, [F.desc("mass"), F.col("name")], 15, ["archetype"]), "hotspots": reports.ranked(board, [F.desc("mass"), F.col("name")], 10),
    }


def publish(tables: dict[str, DataFrame], folder: str) -> int:
    """Write the pages of ``library``'s tables below ``folder`` and give their number."""
    return pages.write(pages.library_pages(tables), folder)
