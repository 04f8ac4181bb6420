"""The whole of each input is taken: results against brute force on small tables."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import beliefs, graph, scans, vectors
from tessera.plans.queries import QUERIES
from tessera.streaming import jobs


def test_belief_fold_takes_every_user(spark, tmp_path):
    kinds = ["view", "signup", "purchase", "error", "click"]
    users = [7] * 600 + [1, 2, 3, 10, 11, 20] * 4  # a hot user that is no multiple of ten
    rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=i * 37 % 101), u, kinds[i * i % 5 if u != 7 else i % 3 // 2]) for i, u in enumerate(users)]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type"])
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    want = {}
    for r in events.sort_values(["ts", "event_id"]).itertuples():
        p, support, n = want.get(r.user_id, ([0.2] * 5, 0.0, 0))
        trust = 0.6 + r.event_id % 4 / 10
        want[r.user_id] = jobs.updated(p, beliefs.ARCHETYPES[kinds.index(r.event_type)], (0.5 + r.event_id % 5 / 10) * trust), support + trust, n + 1
    got = {r["user_id"]: r for r in QUERIES["belief_fold"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and got[7]["n"] == 600
    for u, (p, support, n) in want.items():
        assert [got[u][a.lower()] for a in beliefs.ARCHETYPES] == pytest.approx(p, abs=1e-6) and (got[u]["support"], got[u]["n"]) == (pytest.approx(support), n)


def test_lineage_follows_chains_to_the_end(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000 + i, 1000 + i // 2 if i else None) for i in range(1, 50)]  # a chain, a tree whose first parent is itself no row
    rows = [(i, None if p == 1000 else p) for i, p in rows] + [(2000, 5000), (3000, 3001), (3001, 3000)]  # a parent that is no row, a cycle
    got = {r["id"]: (r["root"], r["hops"]) for r in graph.lineage(spark.createDataFrame(rows, "id long, parent long")).collect()}
    up = dict(rows)
    assert len(got) == len(rows)
    for i in up:
        if i < 3000:
            root, hops = i, 0
            while up.get(root) is not None:
                root, hops = up[root], hops + 1
            assert got[i] == (root, hops)


def test_walks_start_from_every_node(spark, tmp_path):
    customer = pd.DataFrame({"c_custkey": range(1, 61), "c_nationkey": [i % 25 for i in range(60)]})
    customer.to_parquet(tmp_path / "customer.parquet")
    out = {(k, (k * 7 + n) % 1000) for k, n in zip(customer.c_custkey, customer.c_nationkey, strict=True)}

    def walked(edges):
        found = {}
        for start in {x for e in edges for x in e}:
            front, seen = {start}, {start}
            for depth in (1, 2, 3):
                front = {b for a, b in edges if a in front} - seen
                seen |= front
                found |= {(start, x): depth for x in front}
        return found

    rings = {(r["start"], r["node"]): ["direct", "secondary", "tertiary"].index(r["ring"]) + 1 for r in QUERIES["blast_radius"](spark, str(tmp_path)).collect()}
    assert rings == walked(out)
    both = {(r["start"], r["node"]): r["depth"] for r in QUERIES["call_path_trace"](spark, str(tmp_path)).collect()}
    assert both == walked(out | {(b, a) for a, b in out})


def test_branch_diff_takes_every_source_and_length(spark, tmp_path):
    texts = ["same size", "equal len", "some text", "  ", "more text", "line text", "last text", "next text"]
    rows = [(i, t, f"src{i + 17}", len(t)) for i, t in enumerate(texts)]
    pd.DataFrame(rows, columns=["doc_id", "text", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    got = {r["path"]: r["change"] for r in QUERIES["branch_diff"](spark, str(tmp_path)).collect()}
    assert got == {0: "deleted", 1: "added", 2: "same", 3: "same", 4: "deleted", 5: "added", 6: "same", 7: "modified"}


def test_rules_gates_and_labels_take_every_row(spark, tmp_path):
    d = str(tmp_path)
    pd.DataFrame({"l_orderkey": [3, 7, 17, 10], "l_linenumber": [4, 1, 1, 4], "l_partkey": [1, 1, 2, 3], "l_suppkey": [8, 9, 8, 8]}).to_parquet(tmp_path / "lineitem.parquet")
    orders = pd.DataFrame({"o_orderkey": [3, 4, 10, 15, 22]})  # 3, 10: with an authorization rule, which names the owner where divisible by 3
    orders.to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame({"event_id": [1, 2, 3]}).to_parquet(tmp_path / "events.parquet")
    assert {r["function"] for r in QUERIES["incorrect_authorization"](spark, d).collect()} == {"fn_3"}
    assert {r["function"] for r in QUERIES["missing_authorization"](spark, d).collect()} == {"fn_15", "fn_22"}
    assert {(r["node"], r["callers"]) for r in QUERIES["auth_gates"](spark, d).collect()} == {(1, 2)}
    labels = QUERIES["taint_labels"](spark, d).collect()
    assert len(labels) == 10 and {r["hits"] for r in labels} == {3}


def test_all_scans_has_flows_and_warnings(spark):
    symbols = spark.createDataFrame([("f", "a.py", "x = 7", "", 0.0, 0.0, False)], "name string, file string, code string, docstring string, score double, mass double, exported boolean")
    rules = spark.createDataFrame([], "source_function string, category string, description string")
    flows = spark.createDataFrame([("g", "b.py", 3, "v", "mysqli_query($v)", "TAINTED", 2), ("f", "b.py", 3, "v", "query", "TAINTED", 1), ("f", "b.py", 4, "v", "echo", "SAFE", 3)], "function string, file string, line int, variable string, sink string, state string, seq int")
    warnings = spark.createDataFrame([("f", "a.py", "SECURITY CRITICAL: Use of eval " + "!" * 80), ("f", "a.py", "long line")], "name string, file string, warning string")
    got = {(r["cwe"], r["function"], r["file"], r["severity"], len(r["title"])) for r in scans.all_scans(symbols, rules, flows, warnings).collect()}
    assert got == {("CWE-89", "f", "b.py", "CRITICAL", 27), ("CWE-94", "f", "a.py", "CRITICAL", 80)}


def test_searches_take_every_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "_blocks", lambda df, block, cut=vectors._blocks: cut(df, 70))
    rng = np.random.default_rng(5)
    ids, x = list(range(3, 403)), rng.normal(size=(400, 4)).round(1)  # no row 0 or 1
    x[50], x[200] = x[97], 0
    pd.DataFrame({"vec_id": ids, "embedding": list(x), "label": [i % 3 for i in ids]}).to_parquet(tmp_path / "embeddings.parquet")
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    mass = np.array([1 + 0.3 * (i % 3 or 1) + 0.5 * (i % 2) + 2.0 * (i % 5 == 0) for i in ids])
    top = {(r["query"], r["rank"]): (r["id"], r["similarity"]) for r in QUERIES["vector_search_top10"](spark, str(tmp_path)).collect()}
    pairs = {(r["query"], r["id"]): r["force"] for r in QUERIES["entangled_pairs"](spark, str(tmp_path)).collect()}
    want = {}
    for query in (100, 200, 300, 400):
        cos = unit @ unit[query - 3]
        order = sorted(range(400), key=lambda j, cos=cos: (-round(cos[j], 6), ids[j]))[:10]
        assert [top[query, k + 1][1] for k in range(10)] == pytest.approx([cos[j] for j in order], abs=1e-6) and [top[query, k + 1][0] for k in range(10)] == [ids[j] for j in order]
        force = mass * mass[query - 3] / np.maximum(1 - cos, 1e-5) ** 2
        want |= {(query, ids[j]): force[j] for j in range(400) if j != query - 3 and force[j] > 0.5}
    assert len(top) == 40 and pairs.keys() == want.keys() and all(pairs[k] == pytest.approx(v, rel=1e-4) for k, v in want.items())
