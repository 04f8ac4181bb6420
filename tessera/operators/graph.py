"""Graph operators over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tessera.session import checkpointed

#: Edges (both ways where asked for) that are sent to tasks; partitions of starts; rows that go out together.
MOST_SENT, WALKS, _ROWS = 12_000_000, 96, 100_000


def fan(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, fan_out, fan_in: distinct callees and callers."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    both = e.groupBy(F.col("s").alias("node")).agg(F.count("*").alias("fan_out"), F.lit(0).cast("long").alias("fan_in"))
    both = both.union(e.groupBy(F.col("d").alias("node")).agg(F.lit(0).cast("long"), F.count("*")))
    return both.groupBy("node").agg(F.sum("fan_out").alias("fan_out"), F.sum("fan_in").alias("fan_in"))


def reach(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """start, node, depth: everything within ``depth`` edges of each start, at its least depth; the start itself left out.

    ``direction`` is out, in or both. Up to MOST_SENT edges are sent to all tasks, and each walks from its starts level by level: nothing but the starts is shuffled, however
    much they reach. Beyond, a frontier join a level: each anti-joins what has been seen.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    e = checkpointed({"out": e, "in": back, "both": e.union(back).distinct()}[direction])
    seen = starts.select(F.col(starts.columns[0]).alias("start")).distinct()
    kind = e.schema["src"].dataType
    if seen.schema["start"].dataType == kind == e.schema["dst"].dataType and e.count() <= MOST_SENT:
        return _walked(e, seen, depth, kind)
    return _joined(e, seen, depth)


def _walked(e: DataFrame, starts: DataFrame, depth: int, kind: DataType) -> DataFrame:
    """``reach`` with the edges sent: nodes in order, and for each a slice of its targets' numbers."""
    table = e.toArrow()
    src, dst = (table[c].combine_chunks() for c in ("src", "dst"))
    nodes = pc.unique(pa.concat_arrays([src, dst]))
    from_, to = (pc.index_in(x, nodes).to_numpy(zero_copy_only=False) for x in (src, dst))
    del table, src, dst
    targets = to[np.argsort(from_, kind="stable")].astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(np.bincount(from_, minlength=len(nodes)))])
    sent = e.sparkSession.sparkContext.broadcast((nodes, begin, targets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at, next_ = sent.value
        level = np.full(len(names), -1, np.int8 if depth < 127 else np.int32)  # of the start at hand
        whose, found, deep, n = [], [], [], 0

        def flush(starts_: pa.Array) -> pa.RecordBatch:
            each = list(map(len, found))
            rows = pa.array(np.repeat(np.array(whose, np.int64), each))
            node = names.take(pa.array(np.concatenate(found)))
            out = pa.record_batch([starts_.take(rows), node, pa.array(np.concatenate(deep), pa.int32())], names=["start", "node", "depth"])
            for x in (whose, found, deep):
                x.clear()
            return out

        for batch in batches:
            own = batch.column("start")
            for i, first in enumerate(pc.index_in(own, names).to_pylist()):
                if first is None:
                    continue
                front, seen = np.array([first]), [np.array([first])]
                level[first] = 0
                for d in range(1, depth + 1):
                    each = at[front + 1] - at[front]
                    step = next_[np.arange(each.sum()) + np.repeat(at[front] - (np.cumsum(each) - each), each)]
                    step = step[level[step] < 0]
                    level[step] = d
                    front = step if len(front) == 1 else np.unique(step)  # edges are distinct
                    if not len(front):
                        break
                    seen.append(front)
                    for a in range(0, len(front), _ROWS):  # a hub's rows go out in pieces
                        part = front[a : a + _ROWS]
                        whose.append(i)
                        found.append(part)
                        deep.append(np.full(len(part), d, np.int32))
                        n += len(part)
                        if n >= _ROWS:
                            yield flush(own)
                            n = 0
                for x in seen:
                    level[x] = -1
            if n:
                yield flush(own)
                n = 0

    name = kind.simpleString()
    return starts.repartition(WALKS, "start").mapInArrow(run, f"start {name}, node {name}, depth int")


def _joined(e: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(level))
        frontier = checkpointed(frontier) if level < depth else frontier
        seen = seen.union(frontier)
    return seen.where("depth > 0")


def blast_radius(edges: DataFrame, start: DataFrame) -> DataFrame:
    """start, node, ring: direct, secondary or tertiary, each node once at its least depth; the start itself is in no ring, even if a cycle leads back to it."""
    names = F.get(F.array(F.lit("direct"), F.lit("secondary"), F.lit("tertiary")), F.col("depth") - 1)
    return reach(edges, start, 3).select("start", "node", names.alias("ring"))


def lineage(parents: DataFrame, depth: int | None = None) -> DataFrame:
    """id, root, hops: parent links followed by pointer jumping, ``depth`` hops at most by doubling; cycles end with the bound.

    Without ``depth``, doubling goes on until every root is known.
    """
    at = parents.select("id", F.col("parent").alias("root"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).alias("hops"))
    if depth is None:
        return _whole_lineage(at)
    reached, n = at, 1
    while n < depth:
        a, b = reached.alias("a"), reached.alias("b")
        reached = checkpointed(
            a.join(b, F.col("a.root") == F.col("b.id"), "left").select(
                "a.id", F.coalesce("b.root", "a.root").alias("root"), (F.col("a.hops") + F.coalesce("b.hops", F.lit(0))).alias("hops")
            )
        )
        n *= 2
    return reached.select("id", F.coalesce("root", "id").alias("root"), "hops")


def _whole_lineage(at: DataFrame) -> DataFrame:
    """A row is open while its root may have a parent; only open rows are joined, so the root of a long chain is no hot key.

    Rows that lead into a cycle stay open and end once more hops were made than there are rows.
    """
    state = checkpointed(at.withColumn("open", F.col("root").isNotNull()))
    done, now, n, limit = state.where("not open"), state.where("open"), 1, 2 * state.count()
    while n < limit and not now.isEmpty():
        a, b = now.alias("a"), done.union(now).alias("b")
        state = checkpointed(
            a.join(b, F.col("a.root") == F.col("b.id"), "left").select(
                "a.id", F.coalesce("b.root", "a.root").alias("root"), (F.col("a.hops") + F.coalesce("b.hops", F.lit(0))).alias("hops"), F.coalesce("b.open", F.lit(False)).alias("open")
            )
        )
        done, now, n = done.union(state.where("not open")), state.where("open"), 2 * n
    return done.union(now).select("id", F.coalesce("root", "id").alias("root"), "hops")


def gates(edges: DataFrame, sensitive: Column, least: int = 2) -> DataFrame:
    """node, callers, gate_confidence of callees that ``sensitive`` holds for and that have ``least`` callers or more."""
    n = edges.where(sensitive).groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("callers"))
    return n.where(F.col("callers") >= least).withColumn("gate_confidence", F.least(F.lit(1.0), F.col("callers") / 10))
