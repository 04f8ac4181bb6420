"""Document fingerprints: an invertible Bloom lookup sketch of each text's paragraph digests, in DataFrame functions only.

A sketch has three rows of m cells, m a power of two; a digest goes to one cell of each row, where its count, the exclusive
or of digests and that of their checks are kept. A cell with one digest gives it away, and taking it out of its other cells frees more (peeling);
a sketch that can't be peeled whole is made anew with twice the cells. The sketches of two versions subtract cell by cell, so what both
have cancels and peeling recovers what differs; the larger of two is folded to the smaller's size first. Where
more differs than the smaller can tell, each is peeled whole, at its full size, and the lists are compared.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import shuffle_width

#: A text's first HEAD characters are cut into small pieces, so that short texts have several.
HEAD = 320
#: A piece of the head ends at a line's end, or at the first blank or sentence's mark after 20 characters, or after 60.
SMALL = r"[^\n]{0,20}+[^ .!?|\n]{0,40}+[ .!?|\n]*+"
#: A paragraph ends at a line's end, or at the first sentence's mark after 160 characters, or at the latest after 400.
PARAGRAPH = r"[^\n]{0,160}+[^.!?|\n]{0,240}+[.!?|\n]*+"
#: Cells in each of the three rows at least, and how often a sketch is made anew with twice as many.
LEAST, DOUBLINGS = 4, 12
SKETCH = "struct<m:int,cells:array<struct<i:int,n:int,x:bigint,c:bigint>>,listed:array<bigint>>"


def paragraphs(text: Column) -> Column:
    """The distinct 60-bit digests of a text's paragraphs; an empty text has none."""
    pieces = F.concat(
        F.regexp_extract_all(F.substring(text, 1, HEAD), F.lit(SMALL), F.lit(0)), F.regexp_extract_all(F.substring(text, HEAD + 1, 2**31 - 1), F.lit(PARAGRAPH), F.lit(0))
    )
    digest = lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 15), 16, 10).cast("long")
    return F.array_distinct(F.transform(F.filter(pieces, lambda p: p != ""), digest))


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _check(digest: str) -> str:
    """Sixteen bits that exclusive or does not carry over."""
    return f"(({digest} % 65521) * ({digest} % 65519) % 65536)"


def _cells(digest: str, m: str) -> list[str]:
    """The digest's cell in each of the three rows of m."""
    return [f"cast({row} * {m} + shiftright({digest}, {row * 17 + 3}) % {m} as int)" for row in range(3)]


def _entries(digests: str, m: str, digest: str = "d", count: str = "1") -> str:
    """What each digest adds to its cells."""
    each = ", ".join(f"struct({i} as i, {count} as n, {digest} as x, k as c)" for i in _cells(digest, m))
    return f"flatten(transform({digests}, d -> {_let(_check(digest), 'k', f'array({each})')}))"


def _merged(entries: str) -> str:
    """Entries added up by cell; cells that cancel go. A sort brings a cell's entries together, so the work is by entry, not by cell."""
    begins = "filter(sequence(0, size(e) - 1), k -> k = 0 or e[k].i <> e[k - 1].i)"
    run = "slice(e, k + 1, coalesce(get(b, j + 1), size(e)) - k)"
    added = "struct(o.i as i, o.n + v.n as n, o.x ^ v.x as x, o.c ^ v.c as c)"
    summed = f"transform(b, (k, j) -> case when coalesce(get(b, j + 1), size(e)) = k + 1 then e[k] else aggregate({run}, struct(e[k].i as i, 0 as n, 0L as x, 0L as c), (o, v) -> {added}) end)"
    some = _let(begins, "b", f"filter({summed}, c -> c.n <> 0 or c.x <> 0 or c.c <> 0)")
    return _let(f"sort_array({entries})", "e", f"case when size(e) = 0 then e else {some} end")


def _peel(cells: str, m: str) -> str:
    """The digests that only a (a positive count) and that only b has, struct<a, b>, by peeling; null if some cells remain.

    A cell gives its digest away if its count is 1 or -1 and both its check and its place fit; each round
    takes what was given out of the other cells. Rounds end when none is given.
    """
    row = f"cast(c.i div {m} as int)"
    pure = f"abs(c.n) = 1 and {_check('c.x')} = c.c and c.i = {row} * {m} + shiftright(c.x, {row} * 17 + 3) % {m}"
    side = lambda n: f"array_distinct(transform(filter(f, c -> c.n = {n}), c -> c.x))"
    given = _let(f"filter(s.cells, c -> {pure})", "f", f"struct({side(1)} as a, {side(-1)} as b)")
    left = _merged(f"concat(s.cells, {_entries('f.a', m, count='-1')}, {_entries('f.b', m)})")
    step = _let(
        given,
        "f",
        f"case when size(f.a) + size(f.b) = 0 then struct(s.cells as cells, s.a as a, s.b as b, false as live) "
        f"else struct({left} as cells, concat(s.a, f.a) as a, concat(s.b, f.b) as b, true as live) end",
    )
    none = "cast(array() as array<bigint>)"
    return (
        f"aggregate(sequence(1, 40), struct({cells} as cells, {none} as a, {none} as b, true as live), "
        f"(s, t) -> case when s.live and size(s.cells) > 0 then {step} else s end, "
        "s -> case when size(s.cells) = 0 then struct(s.a as a, s.b as b) end)"
    )


def sketch(digests: str) -> Column:
    """The sketch of a digest list, struct<m, cells, listed>: what it gives away by itself is ``listed``, all its digests.

    Its first size is the least power of two for two cells a digest and two to spare; it is doubled while peeling gets stuck.
    """
    first = f"greatest({LEAST}, shiftleft(1, length(bin(cast(ceil((2 * size({digests}) + 6) / 3) as int) - 1))))"
    # Peeling, with the digests at hand: those alone in a cell come off, and the cells of the rest are made again.
    off = lambda rest, cells: f"array_except({rest}, transform(filter({cells}, c -> c.n = 1), c -> c.x))"
    less = _let(_merged(_entries("u.rest", "m")), "h", _let(off("u.rest", "h"), "r", "struct(r as rest, size(r) < size(u.rest) as live)"))
    stuck = f"aggregate(sequence(1, 40), struct({off(digests, 'g')} as rest, true as live), (u, w) -> case when u.live and size(u.rest) > 0 then {less} else u end, u -> size(u.rest) > 0)"
    done = f"case when not l or t = {DOUBLINGS} then struct(m as m, g as cells, case when l then cast(array() as array<bigint>) else {digests} end as listed) end"
    one = _let(_merged(_entries(digests, "m")), "g", _let(stuck, "l", done))
    tried = f"aggregate(sequence(0, {DOUBLINGS}), cast(null as {SKETCH}), (s, t) -> case when s is null then {_let(f'shiftleft({first}, t)', 'm', one)} else s end)"
    return F.expr(tried)


def _folded(of: str, m: str, sign: str) -> str:
    """The cells of a sketch as those of one with ``m`` cells a row."""
    return f"transform({of}.cells, c -> struct(cast((c.i div {of}.m) * {m} + c.i % {m} as int) as i, {sign}c.n as n, c.x as x, c.c as c))"


def differing(a: str, b: str) -> Column:
    """The digests that only sketch ``a`` and only sketch ``b`` have: struct<a array<bigint>, b array<bigint>>.

    The mean of a row's squared counts estimates how many they are; peeling is left out where they can't fit.
    """
    fits = "aggregate(g, 0L, (o, c) -> o + c.n * c.n) <= 8 * m"
    less = _let(_merged(f"concat({_folded(a, 'm', '')}, {_folded(b, 'm', '-')})"), "g", f"case when {fits} then {_peel('g', 'm')} end")
    whole = f"struct(array_except({a}.listed, {b}.listed) as a, array_except({b}.listed, {a}.listed) as b)"
    return F.expr(f"coalesce({_let(f'least({a}.m, {b}.m)', 'm', less)}, {whole})")


def fingerprint(of: str) -> Column:
    """A sketch as text: cells a row, then number, count, digests and check of each cell that isn't empty; empty for an empty text."""
    cells = f"array_join(transform({of}.cells, c -> concat_ws('.', c.i, c.n, lower(hex(c.x)), lower(hex(c.c)))), '-')"
    return F.expr(f"case when size({of}.cells) = 0 then '' else concat({of}.m, ':', {cells}) end")


def parsed(of: str) -> Column:
    """The sketch that a fingerprint's text stands for."""
    number = lambda x: f"cast(conv({x}, 16, 10) as bigint)"
    cell = _let("split(t, '[.]')", "f", f"struct(cast(f[0] as int) as i, cast(f[1] as int) as n, {number('f[2]')} as x, {number('f[3]')} as c)")
    cells = f"transform(filter(split(substring_index({of}, ':', -1), '-'), t -> t <> ''), t -> {cell})"
    m = f"case when {of} = '' then {LEAST} else cast(substring_index({of}, ':', 1) as int) end"
    return F.expr(_let(m, "m", _let(cells, "g", f"struct(m as m, g as cells, coalesce({_peel('g', 'm')}.a, cast(array() as array<bigint>)) as listed)")))


def likeness(a: str, b: str, difference: str) -> Column:
    """The part of both sketches' digests that the other has too; 1 for two texts without any."""
    of = lambda s: f"aggregate(filter({s}.cells, c -> c.i < {s}.m), 0, (o, c) -> o + c.n)"
    return F.expr(_let(f"{of(a)} + {of(b)}", "n", f"case when n = 0 then 1D else 1D - (size({difference}.a) + size({difference}.b)) / cast(n as double) end"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, text (null: empty) and ``next``, the text that follows by ascending doc_id, after the last the first.

    ``carry`` names columns made of ``text`` and those named before, and each comes with its next_<name>. Ids are integers; other types raise a TypeError.
    Equal ids follow by a hash of the text; null ids come first, by that hash too. Rows are dealt into ranges of ids, null ones into ranges of the hash, and the first
    row of each range is copied into the range before it, so no task needs to see all rows.
    """
    kind = docs.schema[doc_id].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{doc_id} has to be of an integer type, not {kind}")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    n = ranges or min(20_000, max(2, 2 * shuffle_width(docs.sparkSession)))  # bounds: so many longs on the driver
    bounds = sorted({int(b) for b in docs.select(F.col(doc_id).cast("long").alias("doc_id")).dropna().approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)})
    of_null = F.floor((F.col("hash") / F.lit(float(2**64)) + 0.5) * n).cast("int") - F.lit(n + 1)
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), of_null).otherwise(_place(bounds)))
    first = rows.groupBy("range").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "hash")).alias("head")).collect()  # one row per range
    heads = sorted((r["range"], *r["head"]) for r in first)
    if heads:
        table = [(r, i, h, heads[k - 1][0]) for k, (r, i, h) in enumerate(heads)]
        at = F.broadcast(docs.sparkSession.createDataFrame(table, "range int, head long, hash long, before int"))  # a row for each of at most 40,000 ranges
        r, t = rows.alias("r"), at.alias("t")
        copy = r.join(t, (F.col("r.range") == F.col("t.range")) & (F.coalesce("r.doc_id", F.lit(0)) == F.col("t.head")) & (F.col("r.hash") == F.col("t.hash")))
        rows = rows.withColumn("copied", F.lit(0)).union(copy.select("r.doc_id", "r.text", "r.hash", F.col("t.before"), F.lit(1)))
    else:
        rows = rows.withColumn("copied", F.lit(0))
    rows = rows.repartition(max(n // 2, 1), "range")
    for name, column in (carry or {}).items():
        rows = rows.withColumn(name, column)
    ahead = W.partitionBy("range").orderBy("copied", "doc_id", "hash")
    names = ["text", *(carry or {})]
    rows = rows.withColumn("__next", F.lead(F.struct(*names)).over(ahead)).where("copied = 0")
    follows = [F.coalesce(F.col("__next").getField(c), F.col(c)).alias("next" if c == "text" else f"next_{c}") for c in names]
    return rows.select("doc_id", *names, *follows)


def _place(bounds: list[int]) -> Column:
    """The number of bounds at or below the id: first among each k-th of them, then among the k that follow."""
    if not bounds:
        return F.lit(0)
    k = ceil(len(bounds) ** 0.5)
    listed = lambda xs: F.from_json(F.lit(str(xs)), "array<bigint>")  # a literal once the plan is made
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    coarse = below(listed(bounds[::k]))
    fine = F.get(F.transform(F.array(coarse), lambda c: (c - 1) * k + below(F.slice(listed(bounds), (c - 1) * k + 1, k))), 0)
    return F.when(F.col("doc_id") < bounds[0], 0).otherwise(fine).cast("int")
