"""The behaviour map of an entry point: its calls in breadth-first order, with bounds on depth and states."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpointed

# Files of set-up and configuration, and what a condition compares.
SETUP = r"(?i)^(config.*|bootstrap.*|common|settings|init|setup.*)\.php(\.dist)?$"
COMPARISON = r"([\$\w\(\)\[\]'\"_-]+)\s*==\s*['\"]([\w\.-]+)['\"]"
MACRO = 15  # a map of more transitions is a macro map
_LEVEL = 1 << 40


def contradicts(condition: Column, scenario: tuple[str, ...]) -> Column:
    """Whether a condition compares a scenario's variable with another value; a null or other condition does not."""
    variable, value = (F.regexp_extract(F.coalesce(condition, F.lit("")), COMPARISON, i) for i in (1, 2))
    out = F.lit(False)
    for found in filter(None, (re.search(COMPARISON, s) for s in scenario)):
        out = out | ((variable == found[1]) & (value != found[2]))
    return out


def _within(transitions: DataFrame, max_states: int) -> DataFrame:
    """The transitions that are taken before a start's states, itself included, are ``max_states``."""
    earlier = Window.partitionBy("start").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("start", "dst").orderBy("seq")) == 1
    fresh = transitions.withColumn("fresh", (first & (F.col("dst") != F.col("start"))).cast("long"))
    return fresh.withColumn("states", F.coalesce(F.sum("fresh").over(earlier), F.lit(0)) + 1).where(F.col("states") < max_states).drop("fresh", "states")


def behaviour(
    edges: DataFrame, starts: DataFrame, files: DataFrame | None = None, scenario: tuple[str, ...] = (), max_depth: int = 10, max_states: int = 50
) -> DataFrame:
    """start, step, src, dst, label, is_macro of every transition, ``step`` counting from 1 in the order in which a queue would take them.

    ``edges`` has src, dst, ordinal and condition, ``starts`` start, ``files`` node and file. Each node is expanded at its first
    visit, by ordinal, then name; a call of a visited node is a transition too. Set-up files other than the start's own
    are not expanded. Edges without src or dst, and those that contradict the scenario, are left out; a repeated edge is taken as often.

    A level is a join of the frontier with the edges; a start's rows are bounded by its states and their calls.
    """
    calls = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & ~contradicts(F.col("condition"), scenario))
    calls = calls.select("src", "dst", "ordinal", F.coalesce(F.when(F.col("condition") != "", F.col("condition")), F.lit("calls")).alias("label"))
    popped = starts.where("start is not null").select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("seq")).distinct()
    if files is not None:
        known = files.where("node is not null").groupBy("node").agg(F.min("file").alias("file"))
    visited = popped.select("start", "node").limit(0)
    taken = None
    for level in range(1, max_depth + 1):
        first = popped.join(visited, ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min("seq").alias("seq"))
        if files is not None:
            own = known.select(F.col("node").alias("start"), F.col("file").alias("own"))
            first = first.join(known, "node", "left").join(own, "start", "left")
            setup = F.regexp_extract(F.coalesce("file", F.lit("")), "([^/]*)$", 1).rlike(SETUP) & ~F.col("file").eqNullSafe(F.col("own"))
            first = first.where(~setup).select("start", "node", "seq")
        visited = visited.union(first.select("start", "node"))
        turn = Window.partitionBy("start").orderBy("parent", "ordinal", "dst", "label")
        step = first.withColumnRenamed("seq", "parent").join(calls, F.col("node") == F.col("src"))
        step = step.select("start", (F.row_number().over(turn) + F.lit(level * _LEVEL)).alias("seq"), "src", "dst", "label")
        taken = checkpointed(_within(step if taken is None else taken.union(step), max_states))
        popped = taken.where(F.col("seq") >= level * _LEVEL).select("start", F.col("dst").alias("node"), "seq")
        if popped.isEmpty():
            break
        visited = checkpointed(visited)
    order = Window.partitionBy("start").orderBy("seq")
    return taken.select(
        "start", F.row_number().over(order).alias("step"), "src", "dst", "label", (F.count("*").over(Window.partitionBy("start")) > MACRO).alias("is_macro")
    )
