"""Taint across calls: from each entry point breadth-first through the call graph, variables passed on by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import checkpointed

# What a dangerous sink's name contains.
DANGEROUS = ("echo", "print", "query", "exec", "system", "shell_exec", "eval")


def _contains(text: Column, part: Column) -> Column:
    return F.instr(text, part) > 0


def _passed(flow: Column) -> Column:
    """The callee's name for what a flow hands over: by position, the last parameter beyond them, the first where the place is unknown; without parameters the caller's name."""
    n = F.size("params")
    at = F.when(flow["position"] >= 0, F.least(flow["position"], n - 1)).otherwise(0)
    return F.when(n > 0, F.get(F.col("params"), at)).otherwise(flow["variable"])


def trace(analysed: DataFrame, calls: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """start, step, path, variable, sink, state, severity: flows of tainted variables into dangerous sinks, of each start's walk.

    ``analysed`` is what ``taint.analysed`` gives, one row a symbol; ``calls`` has src, dst and ordinal; ``starts`` start. Symbols are visited
    once, as a queue would: the first visit decides on the path and on what comes in tainted. A symbol's own tainted variables and those that come in are
    looked for in its flows; a flow into a callee (either name holds the other) taints the parameter at its place. Unknown symbols end
    a walk. Repeated starts are one, and nulls are left out; ``max_depth`` bounds the calls on a path. A level is a join of the frontier with the edges.
    """
    names = F.transform(F.filter("variables", lambda v: v["state"] == "TAINTED"), lambda v: v["variable"])
    known = analysed.where("symbol is not null").groupBy("symbol").agg(F.first(F.struct(names.alias("own"), "flows", "params")).alias("s")).select("symbol", "s.*")
    known = checkpointed(known)
    edges = calls.where("src is not null and dst is not null").select("src", "dst", "ordinal")
    takes = known.select(F.col("symbol").alias("callee"), "params")
    edges = checkpointed(edges.join(takes, F.col("dst") == F.col("callee"), "left").drop("callee"))
    none = F.expr("cast(array() as array<string>)")
    popped = starts.select(F.col(starts.columns[0]).cast("string").alias("start")).where("start is not null").distinct()
    popped = popped.select("start", F.col("start").alias("node"), none.alias("came"), F.col("start").alias("path"), F.lit(0).cast("long").alias("ord"))
    visited, found, depth = popped.select("start", "node").limit(0), [], 0
    while True:
        fresh = popped.join(visited, ["start", "node"], "left_anti")
        first = fresh.groupBy("start", "node").agg(F.min_by(F.struct("came", "path", "ord"), "ord").alias("f")).select("start", "node", "f.*")
        here = first.join(known, F.col("node") == F.col("symbol")).drop("symbol", "params").withColumn("tainted", F.array_union("came", "own"))
        here = checkpointed(here.withColumn("flows", F.filter("flows", lambda f: F.array_contains("tainted", f["variable"]))))
        visited = checkpointed(visited.union(first.select("start", "node")))
        bad = lambda f: reduce(lambda a, w: a | F.contains(F.lower(f["sink"]), F.lit(w)), DANGEROUS, F.lit(False))
        hit = here.select("start", F.lit(depth).alias("level"), "ord", "path", F.posexplode(F.filter("flows", bad)).alias("at", "f"))
        found.append(hit.select("start", "level", "ord", "at", "path", "f.variable", "f.sink", "f.state"))
        if depth == max_depth or here.isEmpty():
            break
        out = here.join(edges, F.col("node") == F.col("src"))
        meets = lambda f: (f["sink"] != "") & (_contains(F.col("dst"), f["sink"]) | _contains(f["sink"], F.col("dst")))
        came = F.array_distinct(F.transform(F.filter("flows", meets), _passed))
        turn = W.partitionBy("start").orderBy("ord", "ordinal", "dst")
        popped = out.join(visited.select("start", F.col("node").alias("dst")), ["start", "dst"], "left_anti")
        popped = popped.select("start", F.col("dst").alias("node"), came.alias("came"), F.concat("path", F.lit(" -> "), "dst").alias("path"), F.row_number().over(turn).cast("long").alias("ord"))
        popped = checkpointed(popped)
        if popped.isEmpty():
            break
        depth += 1
    every = reduce(DataFrame.union, found)
    step = F.row_number().over(W.partitionBy("start").orderBy("level", "ord", "at"))
    severity = F.when(F.col("state") == "TAINTED", "CRITICAL").otherwise("HIGH")
    return every.select("start", step.alias("step"), "path", "variable", "sink", "state", severity.alias("severity"))
