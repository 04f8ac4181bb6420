import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import beliefs, graph, relational, scans, simulation, vectors
from tessera.plans.queries import ORACLES, QUERIES
from tessera.streaming import jobs

SF = "/root/testdata/sf0.001"


def value(spark, column, **fields):
    row = spark.createDataFrame([tuple(fields.values())], list(fields)) if fields else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_scores(spark):
    lit = F.lit
    assert value(spark, scores.activation(lit(0.8), lit(10.0), lit(-5.0), lit(0.5), lit(1.0))) == pytest.approx(0.8 * math.log(11) * 5 * 0.5)
    assert value(spark, scores.mass(lit(0), lit(None), lit(True))) == pytest.approx(3.3)
    assert value(spark, scores.learning_rate(lit(-9.0))) == pytest.approx(0.9)
    assert value(spark, scores.cosine(F.array(lit(0.0), lit(0.0)), F.array(lit(1.0), lit(0.0)))) == 0


def test_text(spark):
    assert value(spark, text.language_of(F.lit("a/b.tsx"))) == "typescript"
    assert value(spark, text.taint_label(F.lit("$user_id"))) == "USER_ID"
    assert value(spark, text.taint_label(F.lit("csrf_token"))) == "GENERIC_TAINT"
    assert value(spark, text.taint_label(F.lit("zed"), overrides={"zed": "MINE"})) == "MINE"
    assert value(spark, text.best_category(F.split(F.lit("only the owner may access"), " "))) == "authorization"


def test_sinks(spark):
    assert value(spark, scans.sink_weakness(F.lit("mysqli_query($q)"))) == 89
    assert value(spark, scans.sink_weakness(F.lit("error_log(x)"))) == 532
    assert value(spark, scans.sink_weakness(F.lit("blueprint"))) is None
    flows = spark.createDataFrame([("f", 1, "v", "echo", "TAINTED", 1), ("f", 1, "v", "print", "TAINTED", 2), ("f", 2, "v", "echo", "SAFE", 3)], ["file", "line", "variable", "sink", "state", "seq"])
    assert [r["function"] for r in scans.tainted_sinks(flows).collect()] == ["echo"]


def test_beliefs_floor_and_collapse(spark):
    rows = [("s", i, "Gate", 1.0, 1.0) for i in range(5)] + [("t", 1, "Sink", 1.0, 0.9), ("t", 2, "odd", 1.0, 1.0), ("u", 1, None, None, None)]
    got = {r["s"]: r for r in beliefs.collapse(beliefs.fold(spark.createDataFrame(rows, "s string, at int, k string, w double, t double"), "s", "k", "w", "t", ["at"])).collect()}
    assert got["s"]["probabilities"][0] > 0.8 and min(got["s"]["probabilities"]) >= 0.01 and got["s"]["status"] == "ACTIVE" and got["s"]["winner"] == "Gate"
    assert got["t"]["probabilities"][1] > 0.3 and got["t"]["status"] == "SUPERPOSITION" and "u" not in got
    p = [0.2] * 5
    for _ in range(5):
        p = jobs.updated(p, "Gate", 1.0)
    assert got["s"]["probabilities"] == pytest.approx(p)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), (None, "a")], ["src", "dst"])
    start = spark.createDataFrame([("a",)], ["s"])
    assert {(r["node"], r["ring"]) for r in graph.blast_radius(e, start).collect()} == {("b", "direct"), ("c", "secondary"), ("d", "tertiary")}
    assert {(r["node"], r["depth"]) for r in graph.reach(e, start, 1, "in").collect()} == {("c", 1)}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)], "id long, parent long")
    assert {(r["root"], r["hops"] == r["id"]) for r in graph.lineage(chain, 32).collect()} == {(0, True)}


def test_latest_and_resolve(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, t int, v string")
    assert {tuple(r) for r in relational.latest(df, ["k"], ["t"]).select("k", "v").collect()} == {(1, "b"), (2, None)}
    assert relational.latest(df.limit(0), ["k"], ["t"]).count() == 0
    symbols = spark.createDataFrame([("f:x", 2), ("g:x", 1)], ["name", "seq"])
    hints = spark.createDataFrame([("x",), ("y",)], ["hint"])
    assert {tuple(r) for r in relational.resolve(hints, "hint", symbols, "name", "seq").collect()} == {("x", "g:x"), ("y", "y")}


def test_blocks_make_no_difference(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0], 1.0 + i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, mass double")

    def kernel(a, b, cos):
        return {"id": a.ids, "part": cos.sum(1)}

    small, large = (
        {r["id"]: round(r["s"], 6) for r in vectors.block_pairs(df, kernel, "id long, part double", n).groupBy("id").agg(F.sum("part").alias("s")).collect()} for n in (7, 100)
    )
    assert small == large


def test_simulation_moves(spark):
    df = spark.createDataFrame([(i, 1.0, float(i % 5), float(i // 5), 0.0, 0.0) for i in range(25)], "id long, mass double, x double, y double, vx double, vy double")
    out = simulation.grid_steps(df, 2).collect()
    assert len(out) == 25 and all(math.isfinite(r["x"]) and math.isfinite(r["vy"]) for r in out)


def test_watch_and_belief_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pd.DataFrame({"symbol": ["s"] * 5, "ts": range(5), "kind": ["Gate"] * 5, "weight": 1.0, "trust": 1.0}).to_json(tmp_path / "in/a.json", orient="records", lines=True)
    schema, seen = "symbol string, ts long, kind string, weight double, trust double", []
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    jobs.watch(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "c1"), None).awaitTermination()
    assert seen == [5]
    q = jobs.belief_stream(stream).writeStream.outputMode("update").format("memory").queryName("beliefs").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    row = spark.table("beliefs").first()
    assert row["n"] == 5 and row["probabilities"][0] > 0.8


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name]).df()[list(got.columns)]
    cell = lambda x: None if pd.isna(x) else round(float(x), 5) if isinstance(x, (int, float, np.number)) else str(x)
    rows = lambda df: [tuple(map(cell, r)) for r in df.itertuples(index=False)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, rows(got))) == sorted(map(key, rows(want))) if len(got) else not len(want)
