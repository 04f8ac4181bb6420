"""Tables in and out: symbols and calls, evidence logs, whole files, settings, and upserts.

Paths go through Spark's readers and writers, so they may be in any store that Spark reads.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.relational import latest
from tessera.session import checkpointed

# Fixed values.
KINDS = ("Function", "Method", "Module", "Class", "Interface", "Enum")
DEPENDENCIES = ("Import", "ExternalImport", "StdlibImport", "RelativeImport", "SolidityImport", "Require", "APICall", "HTTPCall")
PRUNED = ("node_modules", ".git", ".venv", "venv", "__pycache__", "build", "dist")
NO_DATAFLOW = ("yaml", "markdown", "toml", "json", "generic")
HEAD = 2048

#: What a symbol's fields are called in the tables that it may come from, first filled one first, and their types.
FIELDS = {
    "name": ("string", ("name",)), "file": ("string", ("file_path", "file", "file_alt")), "line": ("int", ("start_line", "line")), "end_line": ("int", ("end_line",)),
    "signature": ("string", ("signature",)), "docstring": ("string", ("docstring",)), "language": ("string", ("language",)), "code": ("string", ("code", "code_snippet")),
    "complexity": ("double", ("complexity",)), "side_effects": ("double", ("sideEffects", "side_effects")), "exported": ("boolean", ("isExported", "exported")),
    "mass": ("double", ("mass",)), "energy": ("double", ("potential_energy", "energy")), "archetype": ("string", ("semantic_archetype", "archetype")), "target": ("string", ("target",)), "project": ("string", ("project",)),
}


def symbols(raw: DataFrame) -> DataFrame:
    """A symbol table with fixed columns from one whose columns have any of the known names; labels from labels, types or type; null where there is none."""
    have = set(raw.columns)
    out = [F.coalesce(*[F.col(f"`{a}`").cast(kind) for a in names if a in have], F.lit(None).cast(kind)).alias(n) for n, (kind, names) in FIELDS.items()]
    many = [F.col(a).cast("array<string>") for a in ("labels", "types") if a in have]
    many += [F.when(F.col("type").isNotNull(), F.array(F.col("type").cast("string")))] if "type" in have else []
    labels = F.coalesce(*many, F.expr("cast(array() as array<string>)")).alias("labels")
    return raw.select(*out, labels)


def result_set(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Records, map<string, string>, of answers in JSON with columns and rows; a bad answer has none."""
    read = F.from_json(column, "columns array<string>, rows array<array<string>>")
    return answers.select(F.explode(F.transform(read["rows"], lambda r: F.map_from_arrays(read["columns"], F.slice(F.concat(r, F.array_repeat(F.lit(None).cast("string"), F.size(read["columns"]))), 1, F.size(read["columns"]))))).alias("record"))


def listed(value: Column) -> Column:
    """A text that looks like a JSON list as an array of texts; null for others."""
    return F.when(value.rlike(r"(?s)^\s*\[.*\]\s*$"), F.from_json(value, "array<string>"))


def code_symbols(all_: DataFrame) -> DataFrame:
    """Symbols of code: a label among the six kinds, and neither a document's nor a setting's file or name."""
    return all_.where(F.arrays_overlap("labels", F.array(*map(F.lit, KINDS))) & ~text.is_documentation(F.col("file"), F.col("name")))


def dependencies(all_: DataFrame, limit: int | None = None) -> DataFrame:
    """name, kind, file, target, dep_type: symbols whose first label among those of dependencies says what they are."""
    kind = F.get(F.filter("labels", lambda x: x.isin(*DEPENDENCIES)), 0)
    rows = all_.where(~text.is_documentation(F.col("file"), F.col("name"))).withColumn("kind", kind).where("kind is not null")
    target = F.coalesce(F.nullif(F.col("target"), F.lit("")), F.col("name"))
    rows = rows.select("name", "kind", "file", target.alias("target"), text.dependency_type(F.col("kind"), target).alias("dep_type"))
    return rows if limit is None else rows.limit(limit)


def search(all_: DataFrame, pattern: str, label: str | None = None, column: str = "name") -> DataFrame:
    """Symbols whose name (or code) has the pattern."""
    return all_.where(F.col(column).rlike(pattern) & (F.array_contains("labels", label) if label else F.lit(True)))


def with_snippets(wanted: DataFrame, snippets: DataFrame) -> DataFrame:
    """``wanted`` with the code of their qualified name (qualified_name, code): one join, not a look-up a row."""
    return wanted.join(snippets.groupBy(F.col("qualified_name").alias("name")).agg(F.first("code", True).alias("snippet")), "name", "left")


def redirectors(all_: DataFrame) -> DataFrame:
    """name: functions that are named for redirecting, or functions and methods whose code sets a header; each once."""
    by_name = search(all_, "[Rr]edirect", "Function").select("name")
    by_code = search(all_, "header", None, "code").where(F.arrays_overlap("labels", F.array(F.lit("Function"), F.lit("Method")))).select("name")
    return by_name.union(by_code).where("name is not null").distinct()


def projects(all_: DataFrame) -> DataFrame:
    return all_.select("project").where("project is not null").distinct()


def architecture(all_: DataFrame) -> DataFrame:
    """label, symbols, files."""
    return all_.select(F.explode("labels").alias("label"), "file").groupBy("label").agg(F.count("*").alias("symbols"), F.countDistinct("file").alias("files"))


def of_project(table: DataFrame, project: str) -> DataFrame:
    """A project's rows of beliefs, entanglements or states."""
    return table.where(F.col("project") == project)


EVIDENCE = "id string, fact string, source string, type string, scope string, trust double, timestamp double, parent_id string, status string, inference_version string, policy_version string, superseded_by string"


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """The evidence log, JSON lines; of an id its last line by file and timestamp, lines that are no JSON left out."""
    rows = spark.read.schema(EVIDENCE + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.withColumn("__file", F.input_file_name()).where("_bad is null and id is not null").drop("_bad")
    return latest(rows, ["id"], ["timestamp", "__file", "status"]).drop("__file")


def evidence_id(*parts: str) -> Column:
    return F.sha2(F.concat_ws("", *[F.col(p).cast("string") for p in parts]), 256)


def append_evidence(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both by key, the last by ``order``; of ties those of ``new``."""
    every = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(every, keys, [*order, "__new"]).drop("__new")


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert into the table at ``path``: a folder of versions, of which the file ``_current`` names the one that holds. Readers of the old version go on reading it."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    pointer = spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(path, "_current"))
    merged = upserted(current(spark, path), new, keys, order) if fs.exists(pointer) else upserted(new.limit(0), new, keys, order)
    version = f"v-{uuid.uuid4().hex}"
    merged.write.parquet(posixpath.join(path, version))
    out = fs.create(pointer, True)
    out.writeBytes(version)
    out.close()
    return current(spark, path)


def current(spark: SparkSession, path: str) -> DataFrame:
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(path, "_current")))
    version = stream.readLine()
    stream.close()
    return spark.read.parquet(posixpath.join(path, version))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, content: whole files, below the folder, without those in pruned folders. Spark passes over files whose name begins with a dot or underscore: settings in such files come as rows."""
    rows = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path)
    pruned = "/(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/"
    relative = F.substring_index(F.regexp_replace("path", "^[a-z]+:/+", "/"), path.rstrip("/") + "/", -1)
    rows = rows.select(relative.alias("path"), "content").where(~F.concat(F.lit("/"), "path").rlike(pruned))
    return rows.select("path", F.col("content").cast("string").alias("content"))


def settings(files: DataFrame) -> DataFrame:
    """name, value, origin of KEY=VALUE lines of .env files (path, content); comments and blank lines left out, quotes taken off; a repeated key's last line counts."""
    env = files.where(F.lower("path").rlike(r"\.env(\.dist)?$")).select("path", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("at", "line"))
    line = F.trim("line")
    rows = env.where((line != "") & ~F.startswith(line, F.lit("#")) & F.contains(line, F.lit("=")))
    name, value = F.trim(F.substring_index(line, "=", 1)), F.regexp_replace(F.trim(F.substr(line, F.instr(line, F.lit("=")) + 1)), "^['\"]+|['\"]+$", "")
    return latest(rows.select(name.alias("name"), value.alias("value"), F.col("path").alias("origin"), "at"), ["name"], ["origin", "at"]).select("name", "value", "origin")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """path of files (path, content) that are new or not as before."""
    both = new.alias("n").join(old.alias("o"), F.col("n.path") == F.col("o.path"), "left")
    return both.where(F.col("o.path").isNull() | ~F.col("o.content").eqNullSafe(F.col("n.content"))).select("n.path")


def default_branch(versions: DataFrame) -> DataFrame:
    """branch: the first of main, master and develop that there is, else main."""
    rank = F.array_position(F.array(F.lit("main"), F.lit("master"), F.lit("develop")), F.col("branch"))
    return versions.where(rank > 0).agg(F.coalesce(F.min_by("branch", rank), F.lit("main")).alias("branch"))


def snapshot(versions: DataFrame, branch: str) -> DataFrame:
    """path, content of a branch in a table of versions (branch, path, content)."""
    return versions.where(F.col("branch") == text.branch_name(branch)).select("path", "content")
