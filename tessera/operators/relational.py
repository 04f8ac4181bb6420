"""Joins, merges, snapshots, ranks and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key by ``order``: an upsert log read as a table. Aggregates before the shuffle, so a hot key is one row a task."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*[F.col(c) if isinstance(c, str) else c for c in order]))
    return df.groupBy(*keys).agg(row.alias("row")).select(*keys, "row.*")


def superseded(df: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """Each observation with the next of its group as ``superseded_by`` and a status."""
    after = F.lead(key).over(W.partitionBy(group).orderBy(order, key))
    return df.withColumn("superseded_by", after).withColumn("status", F.when(F.col("superseded_by").isNull(), "active").otherwise("superseded"))


def merged(graph: DataFrame, sidecar: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge in which the sidecar's values win."""
    g, s = graph.alias("g"), sidecar.alias("s")
    out = [F.coalesce(f"g.{key}", f"s.{key}").alias(key)]
    out += [F.coalesce(f"s.{c}", f"g.{c}").alias(c) for c in columns]
    return g.join(s, F.col(f"g.{key}") == F.col(f"s.{key}"), "full_outer").select(out)


def snapshot_diff(old: DataFrame, new: DataFrame, path: str, content: str) -> DataFrame:
    """path, change (added, deleted, modified, same) between two snapshots; blank or equal contents are the same."""
    o, n = old.alias("o"), new.alias("n")
    a, b = F.col(f"o.{content}"), F.col(f"n.{content}")
    change = F.when(F.col(f"o.{path}").isNull(), "added").when(F.col(f"n.{path}").isNull(), "deleted")
    same = a.eqNullSafe(b) | (F.trim(F.coalesce(a, F.lit(""))) == "") | (F.trim(F.coalesce(b, F.lit(""))) == "")
    change = change.when(same, "same").otherwise("modified")
    return o.join(n, F.col(f"o.{path}") == F.col(f"n.{path}"), "full_outer").select(F.coalesce(f"o.{path}", f"n.{path}").alias(path), change.alias("change"), a.alias("old"), b.alias("new"))


def unique_short_names(symbols: DataFrame, name: str = "name") -> DataFrame:
    """short, name: short names that only one qualified symbol has."""
    short = F.element_at(F.split(name, ":"), -1).alias("short")
    return symbols.groupBy(short).agg(F.count("*").alias("n"), F.min(name).alias("name")).where("n = 1").select("short", "name")


def resolve(hints: DataFrame, hint: str, symbols: DataFrame, name: str, order: str) -> DataFrame:
    """Each hint with the first symbol (by ``order``) whose short name it is, itself where there is none: an equi-join on the short name."""
    short = F.element_at(F.split(name, ":"), -1)
    first = symbols.groupBy(short.alias("__short")).agg(F.min_by(name, order).alias("__name"))
    return hints.join(first, F.element_at(F.split(hint, ":"), -1) == F.col("__short"), "left").withColumn("resolved", F.coalesce("__name", hint)).drop("__short", "__name")


def top_k(df: DataFrame, order: list[Column], k: int, by: list[str] | None = None) -> DataFrame:
    """The first k rows, of each group if ``by`` is given, with their rank. ``order`` must end with a unique key."""
    if by:
        return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def severity_matrix(findings: DataFrame) -> DataFrame:
    """cwe, count and worst rank, with severities that don't occur as zero."""
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MEDIUM", 2).otherwise(3)
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]
    return findings.groupBy("cwe").agg(F.count("*").alias("n"), F.min(rank).alias("worst"), *counts)


def recency_eviction(events: DataFrame, user: str, key: str, ts: str, size: int) -> DataFrame:
    """Keys by last use within each user; beyond ``size`` they are evicted."""
    last = events.groupBy(user, key).agg(F.max(ts).alias("last"))
    rank = F.row_number().over(W.partitionBy(user).orderBy(F.desc("last"), key))
    return last.withColumn("recency", rank).withColumn("evicted", F.col("recency") > size)


def drift_from_cached(events: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """``events`` with ``moved``: how far the value is from the one cached before for its key; null for a key's first."""
    return events.withColumn("moved", F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy(*order)))


def evicted_history(ranked: DataFrame, user: str, most: int = 100) -> DataFrame:
    """The latest ``most`` evicted keys of each user, of what ``recency_eviction`` gives."""
    at = F.row_number().over(W.partitionBy(user).orderBy("recency"))
    return ranked.where("evicted").withColumn("age", at).where(F.col("age") <= most)
