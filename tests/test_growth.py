"""What larger tables ask for: results against plain code, and how much is written or done on the way."""

import re
import time
from hashlib import md5

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tessera.flow import atoms
from tessera.functions import lint
from tessera.operators import graph, reports, simulation, vectors
from tessera.plans import queries
from tessera.plans.queries import PHP, QUERIES


def test_atoms_leave_in_whole_batches(spark):
    codes = [*PHP, "", "$a = 1;\n" * 9000]  # the last has more atoms than go out at once
    k = F.col("id")
    d = spark.range(0, 40_000, 1, 1).select(k.alias("symbol"), F.element_at(F.array(*map(F.lit, codes[:-1])), (k % (len(codes) - 1) + 1).cast("int")).alias("code"), F.lit("php").alias("language"))
    d = d.union(spark.createDataFrame([(-1, codes[-1], "php"), (-2, codes[-1], "php"), (-3, None, "php"), (-4, "echo 1;", "c")], "symbol long, code string, language string"))
    began = time.time()
    got = atoms.atoms(d).groupBy("symbol").agg(F.count("*").alias("n"), F.max("ordinal").alias("last"), F.sort_array(F.collect_list(F.struct("ordinal", *[F.col(c) for c in atoms.COLUMNS]))).alias("all")).where("symbol < 20 or symbol = 39999").collect()
    assert time.time() - began < 25  # a batch for each symbol took longer
    want = {i: atoms.atoms_of(codes[i % (len(codes) - 1)] if i >= 0 else codes[-1]) for i in [-2, -1, *range(20), 39999]}
    assert {r["symbol"] for r in got} == {i for i, found in want.items() if found}
    for r in got:
        assert r["n"] == r["last"] + 1 and [tuple(x) for x in r["all"]] == [(i, *(getattr(a, c) for c in atoms.COLUMNS)) for i, a in enumerate(want[r["symbol"]])]


def test_entry_symbols_meet_files_not_rows(spark):
    names = ["a.py:main", "a.py:other", "b.py:main", "lib/é.php:go", "zz.py:main"]
    symbols = [(n, n.split(":")[0], 10 - i) for i, n in enumerate(names)] + [(f"hot.py:fn_{i}", "hot.py", 100 + i) for i in range(3000)] + [(None, "none.py", 1), ("x", None, 2)]
    entries = [("t", "hot.py", "x")] * 3000 + [("t", f, n) for f, n in (("a.py", "x"), ("é.php", "x"), ("py:m", "x"), ("", "b.py:main"), ("nowhere", "zz.py:main"), (None, "x"), ("nowhere", "nothing"), ("none.py", "x"), ("a.py:main and more", "q"))]
    s, e = spark.createDataFrame(symbols, "name string, file string, seq long"), spark.createDataFrame(entries, "type string, file string, name string")

    def least(fits):
        found = [(q, n) for n, f, q in symbols if n is not None and fits(n, f)]
        return min(found)[1] if found else None

    want = []
    for _, f, n in entries:
        to = f and (least(lambda n, x, f=f: x == f) or least(lambda n, x, f=f: f in n))
        to = to or least(lambda x, _, n=n: x == n)
        want += [(f, n, to)] if to else []
    found = reports.entry_symbols(e, s)
    assert sorted(map(str, (tuple(r)[1:] for r in found.collect()))) == sorted(map(str, want))
    assert rows_joined(found) < 50_000  # 9,000,000 where rows of a file met


def rows_joined(df):
    """The most rows that any join of the plan gave out when ``df`` ran; of stages that adaptive execution ran too."""
    made = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().executedPlan().executeCollect()
    most, todo = 0, [made]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
        if "Join" in name or name == "CartesianProduct":
            metric = node.metrics().get("numOutputRows")
            most = max(most, metric.get().value() if metric.isDefined() else 0)
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.length())]
    return most


def test_blocks_are_not_sent_once_for_each_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "_blocks", lambda df, block, cut=vectors._blocks: cut(df, 70))
    monkeypatch.setattr(vectors, "_TOGETHER", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)).round(1)
    x[50:60], x[200] = x[97], 0  # ties, and a vector without a direction
    pd.DataFrame({"vec_id": range(400), "embedding": list(x), "label": [i % 3 for i in range(400)]}).to_parquet(tmp_path / "embeddings.parquet")
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    cos = unit @ unit.T
    got = {(r["id"], r["rank"]): (r["neighbour"], r["similarity"]) for r in QUERIES["nearest_neighbors_top3"](spark, str(tmp_path)).collect()}
    assert len(got) == 1200
    for i in range(400):
        best = sorted((-round(cos[i, j], 6), j) for j in range(400) if j != i)[:3]
        assert [got[i, r] for r in (1, 2, 3)] == [(j, pytest.approx(-s, abs=1e-6)) for s, j in best]
    mass = np.array([1 + 0.3 * (i % 3 or 1) + 0.5 * (i % 2) + 2.0 * (i % 5 == 0) for i in range(400)])
    force = np.outer(mass, mass) / np.maximum(1 - cos, 1e-5)
    np.fill_diagonal(force, 0)
    assert {r["id"]: r["energy"] for r in QUERIES["energy_scoreboard"](spark, str(tmp_path)).collect()} == pytest.approx(dict(enumerate(-force.sum(1))), rel=1e-6)
    pairs = QUERIES["entangled_pairs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in pairs and "Exchange" not in pairs


def test_walks_shuffle_starts_only(spark, monkeypatch):
    rng = np.random.default_rng(1)
    for kind, name in (("long", int), ("string", "n{}".format)):
        ends = [(name(int(a)), name(int(b))) for a, b in rng.integers(0, 150, (260, 2))] + [(name(i), name(7)) for i in range(100)] + [(name(3), None), (None, name(3)), (name(4), name(4))]
        edges = spark.createDataFrame(ends, f"src {kind}, dst {kind}")
        starts = spark.createDataFrame([(name(i),) for i in (*range(0, 150, 3), 0, 999)] + [(None,)], f"start {kind}")
        for direction in ("out", "in", "both"):
            monkeypatch.setattr(graph, "_ROWS", 37)
            walked = graph.reach(edges, starts, 3, direction)
            plan = walked._jdf.queryExecution().executedPlan().toString()
            monkeypatch.setattr(graph, "MOST_SENT", 0)
            joined = graph.reach(edges, starts, 3, direction)
            monkeypatch.undo()
            assert sorted(map(tuple, walked.collect())) == sorted(map(tuple, joined.collect())) and "Join" not in plan
    assert graph.reach(edges.limit(0), starts, 2).count() == 0


def test_records_that_are_alike_are_linted_once(spark):
    cases = queries.LINT_CASES
    rows = [(*cases[i % len(cases)][:4], cases[i % len(cases)][4] if i % 7 else None, i % 3) for i in range(400)]
    d = spark.createDataFrame(rows, "name string, signature string, docstring string, path string, code string, other long")
    columns = queries._record_columns()
    got = lint.by_record(d, columns, lint.warnings, "w", ("name", "other"))
    count = lambda rows: sorted((r[0], r[1], tuple(r[2])) for r in rows for _ in range(r[3]))
    assert count(got.collect()) == count((*r, 1) for r in d.select("name", "other", lint.warnings(**columns)).collect())
    assert got.count() < 200
    plan = reports.warnings_index(got.withColumnsRenamed({"other": "file", "w": "warnings"}), "n")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate") :]
    assert "Filter" not in below and "Aggregate" in below  # no filter makes the warnings a second time


def test_any_number_of_bodies_moves(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist(), float(m)) for i, m in enumerate(rng.uniform(1, 4, 700))]
    d = spark.createDataFrame(rows, "id long, vector array<double>, mass double")
    one, grid = ({r["id"]: tuple(r)[1:] for r in simulation.simulate(d, 3).collect()}, simulation.calibrate(d, 2).orderBy("g", "k").collect())
    monkeypatch.setattr(simulation, "MOST", 600)
    monkeypatch.setattr(simulation, "_TOGETHER", 64)
    monkeypatch.setattr(simulation, "_PAIRS", 50)
    many = {r["id"]: tuple(r)[1:] for r in simulation.simulate(d, 3).collect()}
    assert one.keys() == many.keys() and all(many[i] == pytest.approx(one[i], rel=1e-9, abs=1e-9) for i in one)
    assert [tuple(r) for r in simulation.calibrate(d, 2).orderBy("g", "k").collect()] == [tuple(r) for r in grid]


def test_words_are_counted_once(spark):
    texts = ["Ab cd, AB!", "", None, "é1 é1 x", " ".join(f"w{i % 500}" for i in range(3000))]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    embedded = d.select("id", vectors.hashed_embedding(F.col("t"), 16).alias("v"))
    for r in embedded.collect():
        words = [w for w in re.split(r"[^\w]+", (texts[r["id"]] or "").lower()) if w]
        want = [sum(int(md5(w.encode()).hexdigest()[:8], 16) % 16 == i for w in words) for i in range(16)]
        assert r["v"] == (None if texts[r["id"]] is None else want)
    plan = embedded.where(F.element_at("v", 1) > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # not once more for the filter
