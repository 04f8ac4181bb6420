"""The commands, end to end over a small code base."""

import pytest

from tessera import api
from tessera.sources import readers

PHP = "<?php\n$id = $_GET['id'];\nshow('x', $id);\n"


@pytest.fixture(scope="module")
def base(spark):
    rows = [
        ("index.php:main", "index.php", 1, "()", "Public endpoint handler", PHP, ["Module"], 3.0, True), ("lib.php:show", "lib.php", 1, "($a, $b)", "Shows it", "$z = $b;\necho $b;\n$password = 'hunter22';\n", ["Function"], 2.0, False),
        ("lib.php:login", "lib.php", 9, "()", "Must check the owner of the account", "$token = $_COOKIE['token'];\nquery($token);\n", ["Function"], 1.0, False), ("util.py:get_x", "util.py", 1, "(a)", "Gets", "return a", ["Function"], 1.0, False),
        ("util.py:run", "util.py", 5, "()", "", "while True:\n    go()", ["Function"], 0.0, False), ("json", "util.py", 1, None, None, None, ["Import"], None, None),
    ]
    raw = spark.createDataFrame(rows, "name string, file string, line int, signature string, docstring string, code string, labels array<string>, complexity double, isExported boolean")
    calls = spark.createDataFrame([("index.php:main", "lib.php:show", 1), ("index.php:main", "lib.php:login", 2), ("util.py:run", "lib.php:login", 3)], "src string, dst string, ordinal int")
    files = spark.createDataFrame([("index.php", PHP), ("lib.php", "x\ny\n"), ("util.py", "z"), ("config.inc.php", "<?php define('KEY', 'v');"), (".env", "A=b")], "path string, content string")
    return readers.symbols(raw), calls, files


def test_score_search_and_entangled(base):
    s, _, _ = base
    top = api.score(s, 3, steps=3).collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and top[0]["score"] >= top[1]["score"]
    assert api.search(s, "account owner check", 1).first()["name"] == "lib.php:login"
    assert "index.php:main" not in {r["name"] for r in api.entangled(s, "index.php:main").collect()}
    assert api.calibrate(s).where("best").count() == 1


def test_rules_dependencies_and_entrypoints(base):
    s, _, files = base
    assert {r["source_function"] for r in api.rules(s).where("category = 'validation' or category = 'authorization'").collect()} >= {"lib.php:login"}
    assert [tuple(r) for r in api.dependencies(s).collect()] == [("util.py", "json", "external", "json")]
    assert {(r["type"], r["file"]) for r in api.entrypoints(files).collect()} == {("fallback", "index.php"), ("setup_config", "config.inc.php"), ("setup_config", ".env")}
    assert {(r["name"], r["value"], r["kind"]) for r in api.constants(files).collect()} == {("KEY", "v", "constant"), ("A", "b", "env")}


def test_audit(base):
    out = api.audit(*base, steps=2)
    found = {(r["cwe"], r["function"]) for r in out["findings"].collect()}
    assert {("CWE-798", "lib.php:show"), ("CWE-400", "util.py:run"), ("CWE-89", "lib.php:login"), ("CWE-862", "index.php:main")} <= found
    paths = {(r["path"], r["variable"], r["sink"], r["severity"]) for r in out["systemic"].collect()}
    assert ("index.php:main -> lib.php:show", "$b", "echo", "HIGH") in paths and ("index.php:main -> lib.php:login", "$token", "query", "CRITICAL") in paths


def test_library(base, tmp_path):
    out = api.library(*base)
    assert api.publish(out, str(tmp_path)) > 10 and "XSS" not in (tmp_path / "symbols/util_py_run.md").read_text()
    assert "CWE-400" in (tmp_path / "symbols/util_py_run.md").read_text() and (tmp_path / "behaviors/index_php_main.json").exists()
    assert {r["node"] for r in out["gates"].collect()} == {"lib.php:login"} and {r["name"] for r in out["zones"].where("zone = 'AUTHENTICATED'").collect()} == {"index.php:main", "util.py:run"}
    steps = [(r["src"], r["dst"]) for r in out["behaviours"].orderBy("step").collect() if r["start"] == "index.php:main"]
    assert steps[:2] == [("index.php:main", "lib.php:show"), ("index.php:main", "lib.php:login")] and ("lib.php:show", "[echo] $b") in steps
    assert {r["file"]: r["lines"] for r in out["files"].collect()}["lib.php"] == 2 and out["coverage"].where("found > 0").count() >= 4
    assert out["warnings"].count() > 0 and out["hotspots"].count() > 0 and out["settings"].count() == 2


def test_diff_and_brain(spark):
    v = spark.createDataFrame([("main", "a.py", "one two three"), ("dev", "a.py", "four five six"), ("dev", "b.py", "new\nfile"), ("main", "c.py", "old"), ("main", "d.md", "x"), ("dev", "d.md", "y")], "branch string, path string, content string")
    got = {r["path"]: (r["change"], r["meaning"]) for r in api.diff(v, "dev", "main").collect()}
    assert got == {"a.py": ("drifted", None), "b.py": ("added", "new file"), "c.py": ("deleted", None)}
    o = spark.createDataFrame([("s", i, "Gate", 1.0, 1.0) for i in range(4)], "s string, at int, kind string, weight double, trust double")
    assert api.brain(o, "s", ["at"]).first()["winner"] == "Gate" and api.sleep(o, "s", ["at"]).first()["observations"] == 4
