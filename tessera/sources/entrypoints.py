"""Where a code base is entered: what its configuration names, files of known names, files whose beginning says so, and set-up files."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
FALLBACK = (
    "main.cpp", "main.c", "main.go", "main.rs", "index.js", "index.ts", "app.py", "main.py", "index.php", "server.js", "server.ts", "index.jsx", "index.tsx",
)
BEGINNINGS = {
    ".php": r"(?is)<\?php.*?(?:require|include)(?:_once)?\s*['\"]", ".py": r"if\s+__name__\s*==\s*['\"]__main__['\"]", ".js": r"app\.listen\s*\(|http\.createServer\s*\(",
}
SETUP = r"(?i)^(config.*\.php(\.dist)?|bootstrap.*\.php(\.dist)?|common\.php(\.dist)?|\.env(\.dist)?|settings\.php(\.dist)?|init\.php(\.dist)?|setup.*\.php(\.dist)?)$"
NAMED = r"entrypoint:\s*['\"]?([a-zA-Z0-9_\-/.]+)['\"]?"
HEAD = 2048


def configured(name: str, content: str) -> list[tuple[str, str]]:
    """(file, name) of each entry point that a configuration file names; none where it can't be read."""
    found: list[tuple[str, str]] = []
    try:
        if name == "package.json":
            data = json.loads(content)
            found += [(data["main"], "main")] if data.get("main") else []
            bins = data.get("bin") or {}
            found += [(path, n) for n, path in bins.items()] if isinstance(bins, dict) else [(bins, data.get("name", "bin"))]
        elif name == "Cargo.toml":
            data = tomllib.loads(content)
            bins, lib = data.get("bin"), data.get("lib")
            found += [(b["path"], b["name"]) for b in bins if "path" in b and "name" in b] if isinstance(bins, list) else []
            found += [(lib["path"], lib.get("name", "lib"))] if isinstance(lib, dict) and "path" in lib else []
        elif name == "pyproject.toml":
            data = tomllib.loads(content)
            for table in (data.get("project"), data.get("tool", {}).get("poetry")):
                scripts = table.get("scripts") if isinstance(table, dict) else None
                found += [(to, n) for n, to in scripts.items()] if isinstance(scripts, dict) else []
        elif name.endswith((".yaml", ".yml")):
            found += [(x, "entrypoint") for x in _in_yaml(content)]
    except (ValueError, AttributeError, TypeError, KeyError):
        return []
    return [(str(file), str(n)) for file, n in found]


def _in_yaml(content: str) -> list[str]:
    try:
        import yaml

        tree = yaml.safe_load(content)
    except Exception:  # no reader, or no YAML: the pattern below
        tree = None
    if not isinstance(tree, dict) or not tree:
        return re.findall(NAMED, content)
    out, stack = [], [iter(tree.items())]
    while stack:
        for key, value in stack[-1]:
            if key == "entrypoint" and isinstance(value, str):
                out.append(value)
            elif isinstance(value, dict):
                stack.append(iter(value.items()))
                break
        else:
            stack.pop()
    return out


def entrypoints(files: DataFrame) -> DataFrame:
    """type, file, name of a code base's entry points; ``files`` has path (from its root) and content.

    Configuration is read at the root only. A file is one entry point unless configuration names it several times; the order of kinds decides: configuration, known names and
    beginnings (the first 2,048 characters), set-up files.
    """
    root = files.where(F.col("path").isin("package.json", "Cargo.toml", "pyproject.toml") | F.col("path").rlike(r"^[^/]*\.ya?ml$"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(path, *x) for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for x in configured(path, content or "")]
            kind, file, name = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([pa.array(x, pa.string()) for x in (kind, file, name)], names=["type", "file", "name"])

    stated = root.select("path", "content").mapInArrow(read, "type string, file string, name string").withColumn("file", F.regexp_replace("file", r"\\", "/"))
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    known = base.isin(*FALLBACK)
    begins = F.lit(False)
    for suffix, pattern in BEGINNINGS.items():
        begins = begins | (F.endswith(base, F.lit(suffix)) & F.substring("content", 1, HEAD).rlike(pattern))
    kind = F.when(known, "fallback").when(begins, "heuristic").when(base.rlike(SETUP), "setup_config")
    named = files.select(kind.alias("type"), F.col("path").alias("file"), F.substring_index(base, ".", 1).alias("name")).where("type is not null")
    return stated.union(named.join(stated.select("file").distinct(), "file", "left_anti").select("type", "file", "name"))


def setup_files(files: DataFrame) -> DataFrame:
    return files.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(SETUP)).select("path")
