"""Helpers that several training-data operators use."""

from __future__ import annotations

import gc
import posixpath
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_folder, checkpointed

__all__ = ["checkpoint_folder", "checkpointed", "components", "kept", "possible", "release", "shared_folder", "shuffle_width"]

#: The filter of ``possible`` has 2**27 bits (16 MB) in 2**11 rows.
_FILTER_BITS, _FILTER_ROWS = 27, 1 << 11


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the checkpoint folder, which driver and executors share; it goes when the application ends."""
    path = posixpath.join(checkpoint_folder(spark), f"tessera-{uuid.uuid4().hex}")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jvm_path)
    files.deleteOnExit(jvm_path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def with_text(docs: DataFrame, text: str, keep: Sequence[str]) -> list[Column]:
    """The text as ``__text``, unless it is a string among the kept columns already: then it goes to Python once. See ``text_of``."""
    again = text in keep and docs.schema[text].dataType.typeName() == "string"
    return [] if again else [F.col(f"`{text}`").cast("string").alias("__text")]


def text_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    """The text column of a batch of ``__kept`` and what ``with_text`` gives."""
    return batch.column("__text") if "__text" in batch.schema.names else batch.column("__kept").field(text)


def kept(docs: DataFrame, keep: Sequence[str], outputs: Sequence[str]) -> tuple[Column, list[Column]]:
    """The columns to keep as one struct ``__kept``, whose fields no other column clashes with, and what takes them out again.

    A column whose name is among ``outputs`` comes out as kept_<name>.
    """
    names = list(dict.fromkeys(keep))
    taken, out = set(outputs) | set(names), []
    for name in names:
        new = name
        if name in outputs:
            new = f"kept_{name}"
            while new in taken:
                new = f"kept_{new}"
            taken.add(new)
        out.append(F.col("__kept").getField(name).alias(new))
    whole = F.struct(*[docs[f"`{n}`"].alias(n) for n in names]) if names else F.struct(F.lit(True).alias("__none"))
    return whole.alias("__kept"), out


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage now: shuffle files go when nothing there refers to them any more."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def possible(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The ``rows`` whose 64-bit hash ``key`` may be in ``keys``, and the rest, which surely is not.

    A filter of 2**27 bits, one for each hash, is broadcast, whatever the number of keys: it saves joins what can't match, most of
    it while ``keys`` has up to some ten million rows.
    """
    spark, last = rows.sparkSession, (1 << _FILTER_BITS) - 1

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((_FILTER_ROWS, (last + 1) // 8 // _FILTER_ROWS), np.uint8)
        for batch in batches:
            at = batch.column("at").to_numpy()
            np.bitwise_or.at(bits.ravel(), at >> 3, (1 << (at & 7)).astype(np.uint8))
        some = np.flatnonzero(bits.any(1))
        for i in range(0, len(some), 64):
            yield pa.record_batch([pa.array(some[i : i + 64]), pa.array([bits[j].tobytes() for j in some[i : i + 64]], pa.binary())], names=["row", "bits"])

    place = F.col(key).bitwiseAND(last)
    parts = keys.select(place.alias("at")).repartition(32, F.shiftright("at", _FILTER_BITS - 11)).mapInArrow(filled, "row long, bits binary")
    full = np.zeros((_FILTER_ROWS, (last + 1) // 8 // _FILTER_ROWS), np.uint8)
    for r in parts.collect():  # each row of bits once at most
        full[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(full.ravel())

    def passed(batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(key).to_numpy() & last
            yield batch.filter(pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1) == wanted))

    return rows.mapInArrow(lambda b: passed(b, 1), rows.schema), rows.mapInArrow(lambda b: passed(b, 0), rows.schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): (node, root).

    Alternates large-star and small-star steps until the edge set is stable;
    ``root`` is the least node of the component. Each round is two grouped
    minima and two equi-joins, so a star of any degree is never collected into
    one row, and adaptive execution may split its partition. Nodes without an
    edge to another node don't appear; an empty input gives an empty result.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select("a", F.col("m").alias("b"))
            )
        return out.where("a <> b").distinct()

    def mark(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        return tuple(row)

    now = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    before = mark(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        now = checkpointed(star(star(now, True), False))
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
