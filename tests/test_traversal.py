import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.operators import traversal


def by_queue(edges, start, max_depth, max_states, skip=()):
    """The same walk with a queue."""
    calls = {}
    for s, d, o, c in sorted(edges, key=lambda e: (e[2], e[1])):
        calls.setdefault(s, []).append((d, c))
    states, out, visited, queue = {start}, [], set(), deque([(start, None, 0, None)])
    while queue and len(states) < max_states:
        node, caller, depth, condition = queue.popleft()
        if caller is not None:
            out.append((caller, node, condition or "calls"))
            states.add(node)
        if depth < max_depth and node not in visited and node not in skip:
            visited.add(node)
            queue.extend((d, node, depth + 1, c) for d, c in calls.get(node, []))
    return out


@pytest.mark.parametrize("depth,states,seed", [(10, 50, 1), (3, 50, 2), (10, 6, 3), (4, 1, 4)])
def test_behaviour_is_the_queue_walk(spark, depth, states, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", i, rng.choice([None, "", "x == 'a'"])) for i in range(30)]
    e = spark.createDataFrame([*edges, (None, "n1", 1, None), ("n1", None, 2, None)], "src string, dst string, ordinal int, condition string")
    starts = ["n0", "n3", "nowhere"]
    got = traversal.behaviour(e, spark.createDataFrame([(s,) for s in [*starts, "n0", None]], "start string"), max_depth=depth, max_states=states).collect()
    for s in starts:
        want = by_queue(edges, s, depth, states)
        rows = sorted((r for r in got if r["start"] == s), key=lambda r: r["step"])
        assert [(r["src"], r["dst"], r["label"]) for r in rows] == want
        assert [r["step"] for r in rows] == list(range(1, len(want) + 1))
        assert all(r["is_macro"] == (len(want) > 15) for r in rows)


def test_setup_files_and_scenarios(spark):
    edges = [("a", "b", 1, "level == 'low'"), ("a", "c", 2, "level == 'high'"), ("a", "d", 3, None), ("d", "e", 1, None), ("b", "f", 1, None)]
    e = spark.createDataFrame(edges, "src string, dst string, ordinal int, condition string")
    files = spark.createDataFrame([("a", "x/a.php"), ("d", "x/Config.inc.php"), ("b", None)], "node string, file string")
    start = spark.createDataFrame([("a",)], "start string")
    got = traversal.behaviour(e, start, files, ("level == 'low'",)).orderBy("step").collect()
    assert [(r["src"], r["dst"], r["label"]) for r in got] == [("a", "b", "level == 'low'"), ("a", "d", "calls"), ("b", "f", "calls")]
    inside = traversal.behaviour(e, spark.createDataFrame([("d",)], "start string"), files).collect()
    assert [(r["src"], r["dst"]) for r in inside] == [("d", "e")]


def test_empty(spark):
    e = spark.createDataFrame([], "src string, dst string, ordinal int, condition string")
    assert traversal.behaviour(e, e.select(F.col("src").alias("start"))).count() == 0
