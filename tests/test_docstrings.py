import pytest
from pyspark.sql import functions as F

from tessera.functions import docstrings

CASES = [
    ("python", "Adds.\nValues must be positive.\n\nArgs:\n    a (int): first: one\n    b: second\n  not a parameter\nReturns:\n    float: the sum\n    of both\n",
     [("a", "int", "first: one"), ("b", "", "second")], ("float", "the sum of both"), ["Values must be positive."]),
    ("python", "Args:\n    old: gone\nArgs:\n    new: kept\nReturns:\n    int\n", [("new", "", "kept")], ("int", ""), []),
    ("python", "Return:\n  what was asked\n  for", [], ("", "what was asked for"), []),
    ("javascript", "/** Must check the owner. */\n * @param {string} id the id\n * @param n  count \n * @returns {number} total",
     [("id", "string", "the id"), ("n", "", "count")], ("number", "total"), ["Must check the owner."]),
    ("TypeScript", "@return nothing much", [], ("", "nothing much"), []),
    ("solidity", "@dev low level\n@notice Pays out\n@param to receiver\n@return ok whether paid", [("to", "", "receiver")], ("", "whether paid"), ["Pays out", "low level"]),
    ("go", "// Sum adds up\n// @param {int} a first one\n// @param b int second\n// @param c third\n// @return int the sum",
     [("a", "int", "first one"), ("b", "int", "second"), ("c", "", "third")], ("int", "the sum"),
     ["Sum adds up", "@param {int} a first one", "@param b int second", "@param c third", "@return int the sum"]),
    ("rust", "/// Input should be sorted\n# Arguments\n* `x` - left side\n* `y` - right\n# Returns\nthe larger", [("x", "", "left side"), ("y", "", "right")], ("", "the larger"), ["Input should be sorted"]),
    ("cpp", "/** @brief Multiplies\n * \\param[in] a left\n * The calculation is exact\n * @return product */", [("a", "", "left")], ("", "product */"), ["Multiplies", "The calculation is exact"]),
    ("php", "/**\n * Must be logged in\n * @param {int} $id key\n * @rule only owners\n * also admins\n * @return {bool} done\n */",
     [("$id", "int", "key")], ("bool", "done"), ["only owners", "also admins", "Must be logged in"]),
    ("generic", "must be anything @param a b", [], ("", ""), []),
    ("python", "", [], ("", ""), []),
    ("go", None, [], ("", ""), []),
    (None, "@param a b", [], ("", ""), []),
]


@pytest.fixture(scope="module")
def parsed(spark):
    d = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, language string, doc string")
    doc, language = F.col("doc"), F.col("language")
    out = d.select("i", docstrings.params(doc, language).alias("p"), docstrings.returns(doc, language).alias("r"), docstrings.rules(doc, language).alias("s"))
    return {r["i"]: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_parsers(parsed, i):
    _, _, params, returned, stated = CASES[i]
    assert [tuple(p) for p in parsed[i]["p"]] == params
    assert tuple(parsed[i]["r"]) == returned
    assert parsed[i]["s"] == stated


def test_genome(spark):
    d = spark.createDataFrame(
        [("f", "a, b", "/** Adds. */", ["x", "y"]), (None, "(a)", " ", []), ("g", None, None, None)], "n string, s string, d string, r array<string>"
    )
    got = [r["g"] for r in d.select(docstrings.genome(F.col("n"), F.col("s"), F.col("d"), F.col("r")).alias("g")).collect()]
    assert got == ["f(a, b) — Adds. Rules: x; y", "unknown(a)", "g"]
