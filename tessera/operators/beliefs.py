"""Sequential beliefs over archetypes, observation after observation of each symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# Fixed values.
ARCHETYPES = ("Gate", "Sink", "Transform", "IO", "Storage")
FLOOR, COLLAPSE, GAP, WINDOW = 0.01, 0.8, 0.2, 3


def updated(p: list[float], kind: str, tw: float) -> list[float]:
    """One Bayesian step: a match multiplies by 1 + tw, the others by 1 - tw / 2; what falls to the floor is lifted to it and the rest scaled, five rounds at most."""
    raw = [x * (1 + tw if a == kind else 1 - tw / 2) for a, x in zip(ARCHETYPES, p, strict=True)]
    whole = sum(raw)
    p = [x / whole for x in raw]
    for _ in ARCHETYPES:
        low = [x <= FLOOR for x in p]
        if not any(low) or all(low):
            break
        rest = (1 - FLOOR * sum(low)) / sum(x for x, is_low in zip(p, low, strict=True) if not is_low)
        p = [FLOOR if is_low else x * rest for x, is_low in zip(p, low, strict=True)]
    return p


def _walk(observations: DataFrame, symbol: str, archetype: str, weight: str, trust: str, order: list[str], every: bool) -> DataFrame:
    known = observations.where(F.col(archetype).isin(*ARCHETYPES) & F.col(weight).isNotNull() & F.col(trust).isNotNull())
    rows = known.select(F.col(symbol).alias("symbol"), F.struct(*order).alias("at"), F.col(archetype).alias("kind"), F.col(weight).cast("double").alias("w"), F.col(trust).cast("double").alias("t"))
    kind = rows.schema["symbol"].dataType.simpleString()
    types = to_arrow_type(rows.schema["symbol"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            s, p, support, n = zip(*out, strict=True)
            return pa.record_batch([pa.array(s, types), pa.array(p, pa.list_(pa.float64())), pa.array(support, pa.float64()), pa.array(n, pa.int32())], names=["symbol", "probabilities", "support", "n"])

        now, p, support, n = None, [], 0.0, 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("symbol", "kind", "w", "t"))
            for s, kind_, w, t in zip(*columns, strict=True):
                if not n or s != now:
                    if n and not every:
                        out.append((now, p, support, n))
                    now, p, support, n = s, [1 / len(ARCHETYPES)] * len(ARCHETYPES), 0.0, 0
                p, support, n = updated(p, kind_, w * t), support + t, n + 1
                if every:
                    out.append((now, p, support, n))
            if out:
                yield batch_of()
                out = []
        if n and not every:
            out.append((now, p, support, n))
            yield batch_of()

    dealt = rows.repartition("symbol").sortWithinPartitions("symbol", "at", "kind", "w", "t").drop("at")
    return dealt.mapInArrow(run, f"symbol {kind}, probabilities array<double>, support double, n int").withColumnRenamed("symbol", symbol)


def fold(observations: DataFrame, symbol: str, archetype: str, weight: str, trust: str, order: list[str]) -> DataFrame:
    """symbol, probabilities, support, n: beliefs over the archetypes after a symbol's observations, from a uniform prior.

    The floor makes the update depend on the order, so a symbol's observations are taken one after another; they come sorted and only
    the state is held, however many a symbol has. Unknown archetypes and null weights are left out; a null symbol is one of its own. Streams keep the state from batch to batch (see streaming).
    """
    return _walk(observations, symbol, archetype, weight, trust, order, False)


def timeline(observations: DataFrame, symbol: str, archetype: str, weight: str, trust: str, order: list[str]) -> DataFrame:
    """The state after each observation, n counting from 1; see ``fold``."""
    return _walk(observations, symbol, archetype, weight, trust, order, True)


def collapse(folded: DataFrame) -> DataFrame:
    """Adds winner, status and uncertainty: ACTIVE after WINDOW observations, above COLLAPSE and by more than GAP."""
    names = F.array(*map(F.lit, ARCHETYPES))
    top = F.sort_array("probabilities", asc=False)
    active = (F.col("n") >= WINDOW) & (top[0] > COLLAPSE) & (top[0] - top[1] > GAP)
    winner = F.element_at(names, F.array_position("probabilities", top[0]).cast("int"))
    return folded.withColumns({"status": F.when(active, "ACTIVE").otherwise("SUPERPOSITION"), "winner": F.when(active, winner), "uncertainty": 1 - top[0]})


def context(folded: DataFrame, symbol: str) -> DataFrame:
    """symbol, beliefs (by archetype), status, winner, support, uncertainty of collapsed beliefs, and the sentence that says them."""
    beliefs = F.map_from_arrays(F.array(*map(F.lit, ARCHETYPES)), "probabilities")
    certain = F.coalesce("winner", F.lit("undecided"))
    prose = F.concat(F.col(symbol).cast("string"), F.lit(" is "), certain, F.lit(" ("), F.lower("status"), F.lit(") after "), F.col("n").cast("string"), F.lit(" observations"))
    return folded.select(symbol, beliefs.alias("beliefs"), "status", "winner", "support", "uncertainty", prose.alias("prose"))


def probing_actions(debt: Column) -> Column:
    """What to look into at a level of attention debt: four actions beyond 5, two beyond 2."""
    return (
        F.when(debt > 5.0, F.array(*map(F.lit, ("deep_ast_scan", "expand_call_graph", "fetch_git_history", "request_runtime_traces"))))
        .when(debt > 2.0, F.array(*map(F.lit, ("standard_ast_scan", "check_git_history")))).otherwise(F.expr("cast(array() as array<string>)"))
    )


def sleep_cycle(folded: DataFrame) -> DataFrame:
    """symbols, observations: what a consolidation run goes through."""
    return folded.agg(F.count("*").alias("symbols"), F.coalesce(F.sum("n"), F.lit(0)).alias("observations"))


def of_rules(rules: DataFrame) -> DataFrame:
    """symbol, belief, status, winner, support of rules (source_function, category, confidence, seq): a function's last rule counts, ACTIVE above 0.8."""
    last = rules.groupBy(F.col("source_function").alias("symbol")).agg(F.max_by(F.struct("category", "confidence"), "seq").alias("r"))
    active = F.col("r.confidence") > 0.8
    return last.select(
        "symbol", F.create_map("r.category", "r.confidence").alias("belief"), F.when(active, "ACTIVE").otherwise("SUPERPOSITION").alias("status"),
        F.when(active, F.col("r.category")).alias("winner"), F.col("r.confidence").alias("support"),
    )
