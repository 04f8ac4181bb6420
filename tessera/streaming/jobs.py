"""Streaming jobs: windowed activity, the change watcher, and beliefs kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.beliefs import ARCHETYPES, updated


def activity(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """event_type, start, n, total by tumbling window; with ``late`` a watermark for a stream."""
    if late:
        events = events.withWatermark("ts", late)
    g = events.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select("event_type", F.col("w.start").alias("start"), "n", "total")


def watch(changes: DataFrame, rescore: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = "5 minutes"):
    """Start a query that hands each non-empty batch of changes to ``rescore``; the checkpoint is where it resumes.

    Failures end the query rather than being hidden. ``interval`` None takes what there is and stops.
    """

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            rescore(df, number)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def belief_stream(observations: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Beliefs of (symbol, ts, kind, weight, trust) observations as state: one row a symbol and batch, each update O(1)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        p, support, n = state.get if state.exists else ([1 / len(ARCHETYPES)] * len(ARCHETYPES), 0.0, 0)
        p = list(p)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for r in rows.itertuples():
            if r.kind in ARCHETYPES:
                p, support, n = updated(p, r.kind, r.weight * r.trust), support + r.trust, n + 1
        state.update((p, support, n))
        yield pd.DataFrame({symbol: [key[0]], "probabilities": [p], "support": [support], "n": [n]})

    kind = observations.schema[symbol].dataType.simpleString()
    return observations.groupBy(symbol).applyInPandasWithState(
        step, f"{symbol} {kind}, probabilities array<double>, support double, n int", "p array<double>, support double, n int", "update", "NoTimeout"
    )


def monitor(
    changes: DataFrame, rescore: Callable[[DataFrame, int], None], refresh: Callable[[DataFrame, int], None], checkpoint: str, check: str | None = "5 minutes", dependencies: str | None = "15 minutes"
) -> list:
    """Two queries over the changes with triggers of their own: one rescores, one refreshes dependencies; each resumes where its checkpoint is.

    With intervals None both take what there is and the call returns when they have.
    """
    queries = [watch(changes, rescore, f"{checkpoint}/rescore", check), watch(changes, refresh, f"{checkpoint}/dependencies", dependencies)]
    if check is None and dependencies is None:
        for q in queries:
            q.awaitTermination()
    return queries
