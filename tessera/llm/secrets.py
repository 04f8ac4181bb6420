"""Secret scans with multipart credential linking, in DataFrame functions only.

Spark gives the strings that a pattern matches but not where they are; the pieces of
``split`` by the same pattern have the lengths in between, so running sums of both give every
position. Weak parts (logins, loose tokens, endpoints) are reported only where the parts that
complement them are near, which an interval join over bins of each document finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import checkpointed, kept

# Fixed patterns of the base kinds. Runs of one class are maximal, so their least length is in the pattern.
KEYS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"""({KEYS})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
# Weak parts.
LOGIN = """(?:[Cc]lient_?[Ii]d|[Aa]ccess_?[Kk]ey_?[Ii]d|[Uu]ser_?[Nn]ame|[Uu]ser|[Ll]ogin)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
LOOSE = "[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = """[a-z][a-z0-9+]*://[A-Za-z0-9.:_/@%?&=~-]+"""

#: Kinds in the order of the result, and the role each plays for the others.
KINDS = {"assign": "secret", "access": "login", "hex": "secret", "login": "login", "loose": "secret", "endpoint": "endpoint"}
BASE = ("assign", "access", "hex")
#: Spans of up to so many rows, and four times as many spans of 12 bytes, are broadcast to the rows to keep; beyond, both are joined by a shuffle.
_BROADCAST_ROWS = 200_000


def _found(text: Column, pattern: str, group: int, least: int, may: Column) -> Column:
    """Start and end of each match whose group has ``least`` characters or more; ``may`` is false only where there is none."""
    p = F.lit(pattern)
    pairs = F.zip_with(
        F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"))),
        F.regexp_extract_all(text, p, F.lit(group)),
        lambda x, g: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), F.length(g).alias("g")),
    )
    spans = F.aggregate(
        F.filter(pairs, lambda x: x["n"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.when(
                x["g"] >= least,
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("stop")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    none = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    return F.when(may, spans).otherwise(none)


def _alone(parts: DataFrame) -> DataFrame:
    """``parts`` (rows of __key, start, kind, stop) without weak ones that a stronger one overlaps.

    Base spans are stronger than weak ones, logins and endpoints than loose tokens. A span is overlapped if one that begins earlier ends after its
    begin or one that begins later begins before its end: two running extremes over the spans of a text in order.
    """
    ahead = W.partitionBy("__key").orderBy("start", "kind", "stop").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("__key").orderBy(F.desc("start"), F.desc("kind"), F.desc("stop")).rowsBetween(W.unboundedPreceding, -1)
    base = F.col("kind") < len(BASE)

    def overlapped(by: Column) -> Column:
        return F.coalesce(F.max(F.when(by, F.col("stop"))).over(ahead) > F.col("start"), F.lit(False)) | F.coalesce(
            F.min(F.when(by, F.col("start"))).over(behind) < F.col("stop"), F.lit(False)
        )

    loose = F.col("kind") == list(KINDS).index("loose")
    marked = parts.withColumns({"by_base": overlapped(base), "by_any": overlapped(~loose)})
    return marked.where(base | F.when(loose, ~F.col("by_any")).otherwise(~F.col("by_base"))).drop("by_base", "by_any")


def secret_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", reach: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``spans`` array<struct<start, kind, stop>>, and ``keep``.

    Spans of the whole text (null: empty) in code points, end exclusive, by start and kind: 0 assign, 1 access, 2 hex are always
    reported. A weak part (3 login, 4 loose token with letters and digits, 5 endpoint) overlaps no base span, a loose one no other part either; it is reported only
    if the parts that complement it are within ``reach`` characters of its start: a secret for a login, a login
    for a loose token, both for an endpoint. Base spans count as parts. Parts of one document meet bin by bin, so
    a very long document is not paired with itself. Repeated rows give equal rows; a null doc_id is kept.
    An empty table gives an empty result. A kept column named doc_id or spans comes out as kept_doc_id or kept_spans.

    The patterns run once; what they find, without the texts, is written down and joined with the rows to keep at the end.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole, out = kept(docs, keep, ("doc_id", "spans"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("__text"), F.xxhash64(F.col(doc_id), body).alias("__row"), whole)
    body = F.col("__text")
    sets = F.contains(body, F.lit("=")) | F.contains(body, F.lit(":"))
    found = {
        "assign": _found(body, ASSIGN, 2, 6, sets & body.rlike(ASSIGN)), "access": _found(body, ACCESS, 0, 20, F.contains(body, F.lit("AKIA"))),
        "hex": _found(body, HEX, 0, 24, body.rlike(HEX)), "login": _found(body, LOGIN, 1, 3, sets & body.rlike(LOGIN)),
        "loose": _found(body, LOOSE, 0, 20, body.rlike(LOOSE)), "endpoint": _found(body, ENDPOINT, 0, 8, F.contains(body, F.lit("://"))),
    }
    own = rows.select("doc_id", "__row", "__text", *[v.alias(f"__{k}") for k, v in found.items()])
    part = lambda s: F.substring(body, s["start"] + 1, s["stop"] - s["start"])
    mixed = F.filter("__loose", lambda s: part(s).rlike("[0-9]") & part(s).rlike("[A-Za-z]"))  # a loose token has letters and digits
    kinds = list(KINDS)

    def of_kind(i: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["stop"].alias("stop"))

    def tagged(names, **other: Column) -> Column:
        return F.concat(*[F.transform(other.get(k, F.col(f"__{k}")), of_kind(kinds.index(k))) for k in names])

    own = checkpointed(own.select("doc_id", "__row", F.sort_array(tagged(BASE)).alias("__base"), tagged(kinds[len(BASE) :], loose=mixed).alias("__weak")))

    # Interval join: the start of a weak part against the other parts' reach, bin by bin.
    key = F.struct("doc_id", "__row").alias("__key")
    parts = own.where(F.size("__weak") > 0).select(key, F.concat("__base", "__weak").alias("__parts")).distinct()
    parts = _alone(parts.select("__key", F.inline("__parts")))
    role = F.lit(None)
    for i, k in enumerate(kinds):
        role = F.when(F.col("kind") == i, F.lit(KINDS[k])).otherwise(role)
    weak = parts.where(F.col("kind") >= len(BASE)).withColumn("bin", F.floor(F.col("start") / reach)).alias("w")
    span = F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("stop") + reach) / reach))
    near = parts.withColumn("role", role).withColumn("bin", F.explode(span)).alias("n")
    met = (
        weak.join(
            near,
            F.col("w.__key").eqNullSafe(F.col("n.__key")) & (F.col("w.bin") == F.col("n.bin")) & F.col("w.start").between(F.col("n.start") - reach, F.col("n.stop") + reach),
        )
        .groupBy("w.__key", "w.start", "w.kind", "w.stop")
        .agg(F.bool_or(F.col("n.role") == "login").alias("login"), F.bool_or(F.col("n.role") == "secret").alias("secret"))
        .where(
            F.when(F.col("kind") == kinds.index("login"), F.col("secret"))
            .when(F.col("kind") == kinds.index("loose"), F.col("login"))
            .otherwise(F.col("login") & F.col("secret"))
        )
        .groupBy("__key")
        .agg(F.collect_list(F.struct("start", "kind", "stop")).alias("__linked"))
        .select(F.col("__key.doc_id").alias("doc_id"), F.col("__key.__row").alias("__row"), "__linked")
    )

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.__row") == F.col(f"{b}.__row"))

    both = own.alias("o").join(met.alias("m"), same("o", "m"), "left")
    spans = F.when(F.col("m.__linked").isNull(), F.col("o.__base")).otherwise(F.sort_array(F.concat("o.__base", "m.__linked")))
    both = both.select("o.doc_id", "o.__row", spans.alias("spans"))
    if not keep:
        return both
    some = checkpointed(both.where(F.size("spans") > 0).distinct())
    n_rows, n_spans = some.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    if n_rows <= _BROADCAST_ROWS and n_spans <= 4 * _BROADCAST_ROWS:
        some = F.broadcast(some)
    none = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)")
    joined = rows.select("doc_id", "__row", "__kept").alias("d").join(some.alias("s"), same("d", "s"), "left")
    return joined.select("d.doc_id", "d.__kept", F.coalesce("s.spans", none).alias("spans")).select("doc_id", *out, "spans")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with every span, overlapping ones together, replaced by ``mark``; null stays null."""
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"), s["stop"].alias("at")),
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
