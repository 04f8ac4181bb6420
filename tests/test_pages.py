"""Pages as rows, and their way into a folder."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import pages


def test_symbol_file_and_warning_pages(spark):
    params = "array<struct<name string, type string, description string>>"
    s = spark.createDataFrame(
        [("a.py:f", "a.py", 3, "Function", "(x)", "Does it", [("x", "int", "number")], ["must be"], ["Long"], 2.0, -1.5, "hub"), ("a.py:f", "a.py", 3, "Function", "(x)", "Does it", [("x", "int", "number")], ["must be"], ["Long"], 2.0, -1.5, "hub"),
         ("g", None, None, None, None, None, None, None, None, None, None, None), (None, "a.py", 1, None, None, None, None, None, None, None, None, None)],
        f"name string, file string, line int, kind string, signature string, docstring string, params {params}, rules array<string>, warnings array<string>, mass double, energy double, archetype string",
    )
    near = spark.createDataFrame([("a.py:f", ["g", "g"], [])], "node string, callers array<string>, callees array<string>")
    found = spark.createDataFrame([("CWE-79", "XSS", "a.py:f ", "HIGH"), (None, None, None, None)], "cwe string, title string, function string, severity string")
    got = {r["path"]: r["content"] for r in pages.symbol_pages(s, near, found).collect()}
    assert set(got) == {"symbols/a_py_f.md", "symbols/g.md"}
    page = got["symbols/a_py_f.md"]
    assert page.startswith("# Function: f\n") and page.count("[[symbols/g\\|g]]") == 1 and "- `x` int number" in page and "- CWE-79 XSS (HIGH)" in page and "- **Mass**: 2.00" in page
    assert "Callees" not in page and "Documentation" not in got["symbols/g.md"] and "generic" in got["symbols/g.md"]
    files = spark.createDataFrame([("a.py", 2, 4.0, -1.5, "hub", 9, 100)], "file string, symbols long, mass double, energy double, archetypes string, lines long, bytes long")
    page = pages.file_pages(files, s).first()
    assert page["path"] == "files/a_py.md" and "- **Lines**: 9" in page["content"] and page["content"].count("[[symbols/a_py_f\\|f]]") == 1
    told = spark.createDataFrame([("f", "a.py", "One | two"), ("g", None, "Three")], "name string, file string, warnings string")
    got = {r["path"]: r["content"] for r in pages.warning_pages(told).collect()}
    assert set(got) == {"warnings/a_py.md", "warnings/unknown.md"} and "One \\| two" in got["warnings/a_py.md"]


def test_behaviour_pages_keep_the_order_of_steps(spark):
    rows = [("m", 2, "m", 'say "x"', "calls", False), ("m", 1, "m", "n", "$a == 1", False), ("m", 3, "n", "m", "calls", False)]
    b = spark.createDataFrame(rows, "start string, step int, src string, dst string, label string, is_macro boolean")
    got = {r["path"]: r["content"] for r in pages.behaviour_pages(b).collect()}
    side = json.loads(got["behaviors/m.json"])
    assert side["states"] == ["m", "n", 'say "x"'] and [t["step"] for t in side["transitions"]] == [1, 2, 3]
    assert "s1 --> s2: $a == 1\n    s1 --> s3: calls\n    s2 --> s1: calls" in got["behaviors/m.md"] and "say 'x'" in got["behaviors/m.md"]
    assert pages.behaviour_pages(b.limit(0)).count() == 0


def test_narratives_rank_by_mass_then_name(spark):
    rows = [(f"n{i:02}", 1.0 if i else 5.0, None, "hub") for i in range(12)] + [("z", None, None, None)]
    got = {r["path"]: r["content"] for r in pages.narratives(spark.createDataFrame(rows, "name string, mass double, energy double, archetype string")).collect()}
    assert got["narratives/hub.md"].count("[[") == 10 and "12 symbols with a mass of 16.00" in got["narratives/hub.md"] and "n10" not in got["narratives/hub.md"]
    assert "[[symbols/z\\|z]] (mass 1.00, energy 0.00)" in got["narratives/generic.md"]


def test_write_stays_in_its_folder(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.md", "täxt"), ("c.md", None)], "path string, content string")
    assert pages.write(rows, str(tmp_path / "out")) == 2
    assert (tmp_path / "out/a/b.md").read_text() == "täxt" and (tmp_path / "out/c.md").read_text() == ""
    for bad in ("../x.md", "/etc/x", "a/../../x", "file:/x", None):
        with pytest.raises(Exception, match="leads out"):
            pages.write(rows.limit(1).select(F.lit(bad).cast("string").alias("path"), "content"), str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()
