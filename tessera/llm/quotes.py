"""Chat formatting: quoted passages linked with the messages they come from, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import checkpointed, shuffle_width

#: A quoted line: one or more > with spaces between and after.
QUOTE = r"^[ \t]*(?:>[ \t]?)+"
#: A line that announces a quotation, and goes with it.
ANNOUNCED = r"(?:wrote|writes|said|schrieb|escribió|a écrit)[ \t]*:[ \t]*$"
#: Where a sentence ends inside a passage.
SENTENCE = r"[.!?]+[ \t\n\r\f]+"
#: Marks that keep passages apart while they are one string, and are blank in a text.
_BEGIN, _LEVEL = "\x01", "\x02"


def _lines(text: Column) -> Column:
    """(level, body) of each line: how many > it begins with, and what follows them; -1 for a line that announces quoted ones right behind it."""
    plain = F.translate(F.coalesce(text, F.lit("")), _BEGIN + _LEVEL, "  ")
    level = lambda x: F.coalesce(F.length(F.regexp_replace(F.regexp_substr(x, F.lit(QUOTE)), "[^>]", "")), F.lit(0))
    lines = F.transform(F.split(plain, r"\r?\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, QUOTE, "").alias("body")))

    def settled(whole: Column):
        def one(x: Column, i: Column) -> Column:
            announces = (x["level"] == 0) & x["body"].rlike(ANNOUNCED) & (F.coalesce(F.get(whole, i + 1)["level"], F.lit(0)) > 0)
            return F.struct(F.when(announces, -1).otherwise(x["level"]).alias("level"), x["body"].alias("body"))

        return one

    return F.get(F.transform(F.array(lines), lambda whole: F.transform(whole, settled(whole))), 0)


def _passages(lines: Column) -> Column:
    """(level, text) of each run of lines of one level; a blank line begins a run of its own."""

    def marked(x: Column, i: Column) -> Column:
        goes_on = (i > 0) & (F.get(lines, i - 1)["level"] == x["level"]) & ~x["body"].rlike(r"^[ \t]*$")
        return F.concat(F.when(goes_on, "\n").otherwise(F.concat(F.lit(_BEGIN), x["level"].cast("string"), F.lit(_LEVEL))), x["body"])

    runs = F.split(F.array_join(F.transform(lines, marked), ""), _BEGIN)
    return F.transform(
        F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))),
        lambda r: F.struct(F.substring_index(r, _LEVEL, 1).cast("int").alias("level"), F.substr(r, F.instr(r, F.lit(_LEVEL)) + 1).alias("text")),
    )


def _pieces(text: Column) -> Column:
    """The distinct lines and sentences of a passage without case, marks and runs of white space; sentences go on over line ends."""
    normal = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))
    both = F.concat(F.split(text, "\n"), F.split(F.translate(text, "\n", " "), SENTENCE))
    return F.array_distinct(F.filter(F.transform(both, normal), lambda x: x != ""))


def link_quotations(
    messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", max_rounds: int = 40
) -> DataFrame:
    """One row per row of ``messages``: conv_id, turn, role, reply, parent, root, depth, n_quoted, n_linked, max_level, position.

    A line's quote level is the number of > it begins with; a run of lines of one level is a passage, and a blank line begins another.
    ``reply`` is the text without quoted lines and without a line that announces them right before; white space at its ends goes. Of each
    passage, lines and sentences are hashed after case, marks and white space are evened out, so a quotation that was wrapped anew is still
    found. A quoted passage comes from the earliest turn of the conversation, before the quoting one, that has its longest linked piece
    unquoted (of equally long ones, the latest such turn). ``parent`` is the latest turn that a first-level passage comes from (null: none, the message begins
    a thread); ``root`` and ``depth`` are the thread's first turn and the number of replies from it. ``position`` numbers all rows from 0 in reply
    order: by conversation, thread and turn, a message behind what it answers; rows come range-partitioned and sorted by it.

    n_quoted counts passages, n_linked those whose origin was found; max_level is the deepest level. A null text is empty; a null conv_id
    is a conversation of its own; a message with a null turn neither quotes nor is quoted. Of rows that repeat a turn each is kept, and
    a link goes to the turn. Hashes are grouped before they are joined, so a line that a third of all
    messages repeat is one row for each conversation. An empty table gives an empty result.
    """
    m = messages.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    told = [F.xxhash64("piece").alias("hash"), F.sha1(F.col("piece").cast("binary")).alias("sha")]
    may_quote = F.contains("text", F.lit(">"))
    parsed = lambda of: of.withColumn("lines", _lines(F.col("text"))).withColumn("passages", _passages(F.col("lines")))
    quoted = F.transform(F.filter("passages", lambda p: p["level"] > 0), lambda p, i: F.struct(i.alias("i"), p["level"].alias("level"), _pieces(p["text"]).alias("pieces")))
    quoted = (
        parsed(m.where(F.col("turn").isNotNull() & may_quote))
        .select("conv_id", "turn", F.monotonically_increasing_id().alias("row"), F.explode(quoted).alias("q"))
        .select("conv_id", "turn", "row", "q.i", "q.level", F.explode("q.pieces").alias("piece"))
        .select("conv_id", "turn", "row", "i", "level", F.length("piece").alias("size"), *told)
    )
    quoted = checkpointed(quoted)
    wanted = quoted.select("conv_id", "hash", "sha").distinct()
    key = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.hash") == F.col(f"{b}.hash")) & (F.col(f"{a}.sha") == F.col(f"{b}.sha"))
    unquoted = F.flatten(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: _pieces(p["text"])))
    # Only conversations in which something is quoted are looked through for where it comes from.
    quoting = quoted.select("conv_id").distinct().alias("q")
    asked = m.where("turn is not null").alias("m").join(quoting, F.col("m.conv_id").eqNullSafe(F.col("q.conv_id")), "left_semi")
    said = parsed(asked).select("conv_id", "turn", F.explode(unquoted).alias("piece"))
    said = said.groupBy("conv_id", *told).agg(F.min("turn").alias("source"))
    said = said.alias("s").join(wanted.alias("w"), key("s", "w"), "left_semi")
    links = quoted.alias("q").join(said.alias("s"), key("q", "s") & (F.col("s.source") < F.col("q.turn")), "left")
    passage = links.groupBy("q.conv_id", "q.turn", "q.row", "q.i", "q.level").agg(F.max(F.when(F.col("s.source").isNotNull(), F.struct("q.size", "s.source"))).alias("best"))
    of_turn = passage.select("*", F.col("best.source").alias("source")).groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("level") == 1, F.col("source"))).alias("parent"), F.count("*").alias("n_quoted"), F.count("source").alias("n_linked"), F.max("level").alias("max_level"),
    )
    # Threads by pointer jumping among the turns that answer others: each round doubles the reach.
    jump = checkpointed(of_turn.withColumns({"root": F.col("parent"), "depth": F.when(F.col("parent").isNotNull(), 1)}))
    for _ in range(max_rounds):
        a, b = jump.alias("a"), jump.where("root is not null").alias("b")
        step = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.root") == F.col("b.turn")), "left").select(
            *[f"a.{c}" for c in of_turn.columns],
            F.coalesce("b.root", "a.root").alias("root"),
            (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"),
            F.col("b.root").isNotNull().alias("moved"),
        )
        if jump.isEmpty():
            break
        step = checkpointed(step)
        moved = not step.where("moved").isEmpty()
        jump = step.drop("moved")
        if not moved:
            break
    # A text without > has no quoted line, and so none that announces one.
    own = F.array_join(F.transform(F.filter(_lines(F.col("text")), lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    plain = F.regexp_replace(F.translate("text", _BEGIN + _LEVEL, "  "), r"\r\n", "\n")
    reply = F.regexp_replace(F.when(may_quote, own).otherwise(plain), r"^\s+|\s+$", "")
    base, j = m.select("conv_id", "turn", "role", reply.alias("reply")).alias("m"), jump.alias("j")
    rows = base.join(j, F.col("m.conv_id").eqNullSafe(F.col("j.conv_id")) & (F.col("m.turn") == F.col("j.turn")), "left").select(
        "m.conv_id", "m.turn", "m.role", "m.reply", "j.parent",
        F.coalesce("j.root", "m.turn").alias("root"), F.coalesce("j.depth", F.lit(0)).cast("int").alias("depth"),
        F.coalesce("j.n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("j.n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("j.max_level", F.lit(0)).cast("int").alias("max_level"),
    )
    return _numbered(rows, ["conv_id", "root", "turn", "role", "reply"])


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` range-partitioned and sorted by ``order``, numbered from 0 in ``position``: each partition's rows follow those of the partitions before."""
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = checkpointed(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    sizes = F.broadcast(sizes.select("__part", before))  # a row for each partition
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("__part", part).join(sizes, "__part").select(*rows.columns, place.alias("position"))
