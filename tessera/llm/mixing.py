"""Mixing sources to target weights along a curriculum that changes over training time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import checkpointed, kept, shuffle_width

#: A weight schedule: (training time from 0 to 1, weight) knots, linear in between.
Schedule = Sequence[tuple[float, float]]

#: Weights 3, 1 and 2 over training time: the first source's falls, the third's rises.
CURRICULUM = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))

#: Documents of a source that one window task orders, about.
_PER_RUN = 4_000

WORD = r"[^\x20\x09-\x0D]+"
OUTPUTS = ("doc_id", "source", "size", "source_size", "target", "taken", "position", "last_position")


def _area(schedule: Schedule) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False))


def _inverse_demand(schedule: Schedule, share: Column) -> Column:
    """The training time by which a source has been asked for ``share`` (0 to 1) of all its tokens.

    In a segment the weight is linear, so demand is a quadratic in time; its root is
    taken in the form that also holds for a constant weight.
    """
    total, done, out = _area(schedule), 0.0, F.lit(float(schedule[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        pieces.append((done, area, t0, w0, slope))
        done += area
    for begin, area, t0, w0, slope in reversed(pieces):
        if area <= 0:
            continue
        left = F.greatest(share * F.lit(total) - F.lit(begin), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * left, F.lit(0.0)))
        time = F.lit(t0) + F.when(left > 0, 2 * left / (F.lit(w0) + root)).otherwise(F.lit(0.0))
        out = F.when(share * F.lit(total) <= F.lit(begin + area), time).otherwise(out)
    return out


def mix_sources(
    docs: DataFrame,
    schedules: Sequence[Schedule] = (((0.0, 3.0), (1.0, 3.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (1.0, 2.0))),
    share: float = 1.5,
    most_passes: int = 2,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, position, last_position, and ``keep``.

    Size is the number of words in the whole text (null: 0). Sources in code point order, null
    last, get the schedules in turn, repeating; a source's weight is the integral of its schedule. The
    mix has ``share`` times all words; a source's target stops at ``most_passes`` times its size and
    the excess goes to the others by weight. In a source, documents come in the order of the MD5 of
    their id and their text's MD5, which also tells apart many rows that share an id or have none; a pass takes them one after another until the target, so the last one may be taken
    in part. ``position`` is the training time (0 to 1) at which the cumulative demand for the source
    reaches the document's first word, ``last_position`` that of its last pass; both are null for documents
    that are not taken. Rows come range-partitioned and sorted by position.

    Nulls: a null source is a source of its own; a null doc_id is ordered as an empty string; a null
    or wordless text has size 0 and takes 0. Repeated rows are separate documents, in any order among themselves. Where
    all texts are empty, targets are 0. An empty table gives an empty result. A kept column that is named like one of these comes out as kept_<name>.
    """
    spark = docs.sparkSession
    whole, kept_out = kept(docs, keep, OUTPUTS)
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        whole,
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), digest).cast("binary")).alias("key"),
    )
    narrow = checkpointed(rows) if not keep else rows
    # A source's order is cut into runs by the leading hexadecimal digits of the key: as many as its rows ask for.
    counted = narrow.groupBy("source", F.substring("key", 1, 4).alias("prefix")).agg(
        F.sum("size").alias("words"), F.count("*").alias("rows")
    )
    counted = checkpointed(counted)
    totals = counted.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows"))

    # Water level: with sources by capacity over weight, those before the first that is not filled are capped.
    ranked = totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.lit(None).cast("double")
    for i, schedule in enumerate(schedules):
        weight = F.when(F.col("rank") % len(schedules) == i, F.lit(float(_area(schedule)))).otherwise(weight)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_passes)
    order = [F.col("cap") / F.col("weight"), F.col("rank")]
    upward, whole = W.orderBy(*order), W.partitionBy()
    ranked = (
        ranked.withColumn("before", F.sum("cap").over(upward.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("rest", F.sum("weight").over(upward.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.coalesce("before", F.lit(0))) / F.col("rest"))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn("water", F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.struct(*order))).over(whole))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("water"), F.lit(float("inf"))) * F.col("weight")))
        .withColumn("digits", F.least(F.lit(4), F.ceil(F.log(16.0, F.greatest(F.col("rows") / _PER_RUN, F.lit(1.0))))).cast("int"))
        .select("source", "source_size", "target", "digits", "rank")
    )
    ranked = checkpointed(ranked)
    same = lambda a, b: a.eqNullSafe(b)

    r = ranked.alias("r")
    runs = (
        counted.alias("c")
        .join(r, same(F.col("c.source"), F.col("r.source")))
        .groupBy("r.source", "r.digits", F.expr("substring(c.prefix, 1, r.digits)").alias("run"))
        .agg(F.sum("words").alias("words"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.max("rank").alias("rank"))
        .withColumn("offset", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    )
    by_source = F.broadcast(ranked.select("source", "digits")) if ranked.count() <= 100_000 else ranked.select("source", "digits")
    n = narrow.alias("n")
    dealt = n.join(by_source.alias("s"), same(F.col("n.source"), F.col("s.source"))).select(
        "n.*", F.expr("substring(n.key, 1, s.digits)").alias("run")
    )
    ahead = W.partitionBy("source", "run").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        dealt.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
        .alias("d")
        .join(runs.alias("u"), same(F.col("d.source"), F.col("u.source")) & (F.col("d.run") == F.col("u.run")))
        .select("d.*", "u.source_size", "u.target", "u.rank", (F.col("u.offset") + F.col("d.ahead")).alias("start"))
    )
    goal = F.round("target").cast("long")
    taken, last = F.lit(0).cast("long"), F.lit(None).cast("long")
    for i in range(most_passes):
        from_ = F.col("start") + F.lit(i) * F.col("source_size")
        taken = taken + F.greatest(F.least(goal - from_, F.col("size")), F.lit(0))
        last = F.when((goal > from_) & (F.col("size") > 0), from_).otherwise(last)
    placed = placed.withColumn("taken", taken).withColumn("last_start", last)

    def position(start: str) -> Column:
        at = F.lit(None).cast("double")
        for i, schedule in enumerate(schedules):
            ask = F.col(start) / F.greatest(F.col("target"), F.lit(1.0))
            at = F.when(F.col("rank") % len(schedules) == i, _inverse_demand(schedule, ask)).otherwise(at)
        return F.when(F.col("taken") > 0, at)

    out = placed.select(
        "doc_id", "source", "size", "source_size", "target", "taken", position("start").alias("position"), position("last_start").alias("last_position"), *kept_out,
    )
    return out.repartitionByRange(shuffle_width(spark), F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(
        F.col("position").asc_nulls_last(), "doc_id"
    )
