import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import beliefs, relational, reports
from tessera.sources import entrypoints, readers
from tessera.streaming import jobs


def test_symbols(spark):
    raw = spark.createDataFrame([("run", "a.py", 3, ["Function"], 0.0), ("README", "README.md", 1, ["Module"], None), ("db", "a.py", 1, ["Import"], None), ("header_to", "b.php", 9, ["Function"], None)], "name string, file string, line int, types array<string>, complexity double")
    s = readers.symbols(raw.withColumn("code", F.when(F.col("name") == "run", "header('x')")))
    assert s.columns[:3] == ["name", "file", "line"] and [r["name"] for r in readers.code_symbols(s).collect()] == ["run", "header_to"]
    assert [(r["name"], r["dep_type"]) for r in readers.dependencies(s).collect()] == [("db", "external")]
    assert [r["name"] for r in readers.search(s, "^head", "Function").collect()] == ["header_to"] and {r["name"] for r in readers.redirectors(s).collect()} == {"run"}
    assert {(r["label"], r["symbols"]) for r in readers.architecture(s).collect()} == {("Function", 2), ("Module", 1), ("Import", 1)}
    code = spark.createDataFrame([("run", "go()")], "qualified_name string, code string")
    assert {r["name"]: r["snippet"] for r in readers.with_snippets(s.select("name"), code).collect()}["run"] == "go()"
    answers = spark.createDataFrame([('{"columns": ["a", "b"], "rows": [["1", "[x]"], ["2"]]}',), ("broken",)], "answer string")
    assert [r["record"] for r in readers.result_set(answers).collect()] == [{"a": "1", "b": "[x]"}, {"a": "2", "b": None}]


def test_evidence_and_upserts(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = [{"id": "a", "fact": "x", "timestamp": 1.0}, {"id": "a", "fact": "y", "timestamp": 2.0}, {"id": "b", "fact": "z", "timestamp": 1.0}]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/1.json").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    assert {(r["id"], r["fact"]) for r in readers.evidence(spark, path).collect()} == {("a", "y"), ("b", "z")}
    table, new = str(tmp_path / "t"), spark.createDataFrame([("k", 1, "old"), ("l", 1, "kept")], "key string, at int, v string")
    assert readers.upsert(spark, table, new, ["key"], ["at"]).count() == 2
    again = readers.upsert(spark, table, spark.createDataFrame([("k", 1, "new"), ("l", 0, "late")], "key string, at int, v string"), ["key"], ["at"])
    assert {(r["key"], r["v"]) for r in again.collect()} == {("k", "new"), ("l", "kept")}


def test_files_settings_and_entrypoints(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1\nif __name__ == '__main__':\n    run()\n")
    (tmp_path / "src/node_modules/index.js").write_text("x")
    (tmp_path / "package.json").write_text('{"main": "lib\\\\m.js", "bin": "cli.js", "name": "pk"}')
    (tmp_path / "deploy.yaml").write_text("service:\n  entrypoint: ./start.sh\n")
    (tmp_path / "Cargo.toml").write_text('[[bin]]\nname = "b"\npath = "src/b.rs"\n[lib]\npath = "src/lib.rs"\n')
    files = readers.texts(spark, str(tmp_path))
    assert {r["path"] for r in files.collect()} == {"src/a.py", "package.json", "deploy.yaml", "Cargo.toml"}
    files = files.union(spark.createDataFrame([(".env.dist", "# c\nKEY = 'v=1'\nBAD\nTOKEN=\"t\"\nKEY=w\n")], files.schema))
    assert {(r["name"], r["value"], r["origin"]) for r in readers.settings(files).collect()} == {("KEY", "w", ".env.dist"), ("TOKEN", "t", ".env.dist")}
    got = {(r["type"], r["file"], r["name"]) for r in entrypoints.entrypoints(files).collect()}
    assert got == {
        ("package.json", "lib/m.js", "main"), ("package.json", "cli.js", "pk"), ("Cargo.toml", "src/b.rs", "b"), ("Cargo.toml", "src/lib.rs", "lib"), ("deploy.yaml", "./start.sh", "entrypoint"),
        ("heuristic", "src/a.py", "a"), ("setup_config", ".env.dist", ""),
    }
    assert {(r["name"], r["value"]) for r in reports.prerequisites(readers.settings(files)).collect()} == {("KEY", "********"), ("TOKEN", "********")}


def test_branches(spark):
    v = spark.createDataFrame([("master", "a.py", "x"), ("develop", "a.py", "y"), ("f/1", "b.py", "z")], "branch string, path string, content string")
    assert readers.default_branch(v).first()["branch"] == "master" and readers.default_branch(v.limit(0)).first()["branch"] == "main"
    assert [r["path"] for r in readers.changed(readers.snapshot(v, "master"), readers.snapshot(v, "develop")).collect()] == ["a.py"]


def test_report_joins(spark):
    words = reports.resolved_words(
        spark.createDataFrame([(1, "ROOT . $p . 'HOST' . HOST")], "id int, expression string"),
        spark.createDataFrame([("ROOT", "www", "c.php", "constant"), ("HOST", "h", None, "env")], "name string, value string, origin string, kind string"),
        spark.createDataFrame([(1, "$p", "CONSTANT", "x", "internal", 1), (1, "ROOT", "CONSTANT", "no", "internal", 2)], "id int, variable string, state string, value string, source string, seq int"),
    )
    assert {(r["word"], r["value"], r["source"]) for r in words.collect()} == {("ROOT", "www", "registry (defined in c.php)"), ("HOST", "h", "env"), ("$p", "x", "internal")}
    real = reports.real_files(spark.createDataFrame([("a/x.py",), ("b/y.py",), ("z.py",)], "file string"), spark.createDataFrame([("a/x.py",), ("c/y.py",)], "path string"))
    assert {(r["file"], r["path"]) for r in real.collect()} == {("a/x.py", "a/x.py"), ("b/y.py", "c/y.py"), ("z.py", None)}
    states = spark.createDataFrame([("b", "[redirect] x", "Synthesized", "e"), ("b", "[echo] x", "Synthesized", "e"), ("b", "Redirect: y", "x", "e"), ("b", "e", "Function", "e"), ("b", "location: z", "Function", "e")], "behaviour string, state string, kind string, entry string")
    flows = spark.createDataFrame([("b", "Redirect: y", None)], "behaviour string, source string, sink string")
    assert {r["state"] for r in reports.pruned_states(states, flows).collect()} == {"[echo] x", "Redirect: y", "e", "location: z"}
    labels = spark.createDataFrame([("[include_once] a/b",), ("[echo] " + "x" * 70,), ("echo",), ("a/b/c",), ("Redirect: q",), (None,)], "s string").select(reports.state_label(F.col("s")).alias("l"))
    assert [r["l"] for r in labels.collect()] == ["Include (once): a/b", "Render Output: " + "x" * 60 + "...", "Render Output", "c", "Redirect: q", "unknown"]
    kept = reports.additional(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([("a",), ("b",), ("b",)], "name string"))
    assert sorted(r["name"] for r in kept.collect()) == ["a", "b"]
    found = spark.createDataFrame([(" f ", "CWE-1"), ("f", "CWE-2"), (None, "CWE-3")], "function string, cwe string")
    assert [tuple(r) for r in reports.links(found, "function", "cwe", "findings").collect()] == [("f", ["CWE-1", "CWE-2"])]
    gates = reports.gate_candidates(spark.createDataFrame([("f", "$password"), ("g", "$x")], "symbol string, variable string"))
    assert [r["symbol"] for r in gates.collect()] == ["f"]
    inv = reports.invariants(spark.createDataFrame([("f", ["a == 1", "x" * 100, "{b}"])], "symbol string, constraints array<string>"))
    assert [r["invariant"] for r in inv.collect()] == ["a == 1"]
    last = reports.last_states(spark.createDataFrame([("f", "$x", "A", 1), ("f", "$x", "B", 2)], "file string, variable string, state string, seq int"))
    assert [r["state"] for r in last.collect()] == ["B"]


def test_beliefs_said(spark):
    rows = [("s", i, "Gate", 1.0, 1.0) for i in range(5)] + [(None, 1, "Sink", 1.0, 0.9)]
    o = spark.createDataFrame(rows, "s string, at int, k string, w double, t double")
    told = {r["s"]: r for r in beliefs.context(beliefs.collapse(beliefs.fold(o, "s", "k", "w", "t", ["at"])), "s").collect()}
    assert told["s"]["winner"] == "Gate" and told["s"]["beliefs"]["Gate"] > 0.8 and told["s"]["prose"] == "s is Gate (active) after 5 observations"
    assert [(r["n"], round(r["support"])) for r in beliefs.timeline(o, "s", "k", "w", "t", ["at"]).where("s = 's'").orderBy("n").collect()] == [(i, i) for i in range(1, 6)]
    assert tuple(beliefs.sleep_cycle(beliefs.fold(o, "s", "k", "w", "t", ["at"])).first()) == (2, 6)
    got = [r["a"] for r in spark.createDataFrame([(6.0,), (3.0,), (1.0,)], "d double").select(beliefs.probing_actions(F.col("d")).alias("a")).collect()]
    assert [len(a) for a in got] == [4, 2, 0]


def test_evicted_history(spark):
    e = spark.createDataFrame([("u", f"k{i}", i) for i in range(10)], "u string, k string, ts int")
    ranked = relational.recency_eviction(e, "u", "k", "ts", 3)
    assert [r["k"] for r in relational.evicted_history(ranked, "u", 2).orderBy("age").collect()] == ["k6", "k5"]


def test_refresh_runs_each_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"path": "a.py"}\n')
    stream = spark.readStream.schema("path string").json(str(tmp_path / "in"))
    seen = []
    jobs.monitor(stream, lambda df, n: seen.append(("score", df.count())), lambda df, n: seen.append(("deps", df.count())), str(tmp_path / "c"), None, None)
    assert sorted(seen) == [("deps", 1), ("score", 1)]


def test_a_bad_label_pattern_is_an_error(spark):
    with pytest.raises(ValueError):
        readers.snapshot(spark.createDataFrame([], "branch string, path string, content string"), "-x")
