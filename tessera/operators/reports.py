"""Joins that put symbols, calls, findings, states and behaviours together, and the tables behind the reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.session import checkpointed

# What the forty weaknesses of the coverage table are, and whether one of the scans finds them.
COVERAGE = (
    (79, True), (787, False), (89, True), (352, False), (22, True), (125, False), (78, True), (416, False), (862, True), (434, False),
    (94, True), (20, False), (77, True), (287, False), (269, False), (502, True), (200, True), (863, True), (918, True), (119, False),
    (476, False), (798, True), (190, False), (400, True), (306, True), (770, False), (668, False), (74, True), (427, False), (639, True),
    (532, True), (732, True), (601, True), (362, True), (522, False), (276, True), (203, False), (59, False), (843, False), (312, True),
)
#: Labels of variables that make a gate, and of scenarios that come first.
GATE_LABELS = ("AUTH_TOKEN", "CREDENTIAL", "SESSION_ID", "TOKEN_FRAGMENT")
FIRST_LABELS = ("PRIVILEGE_LABEL", "AUTH_TOKEN", "SESSION_ID", "USER_ID")


def qualified_calls(calls: DataFrame) -> DataFrame:
    """src, dst of calls (caller, caller_file, callee, callee_file) that have all four, qualified by file."""
    every = reduce(Column.__and__, [F.coalesce(F.col(c), F.lit("")) != "" for c in ("caller", "caller_file", "callee", "callee_file")])
    return calls.where(every).select(F.concat_ws(":", "caller_file", "caller").alias("src"), F.concat_ws(":", "callee_file", "callee").alias("dst"))


def adjacency(calls: DataFrame) -> DataFrame:
    """node, callers, callees: arrays in order of the call's ordinal, repeated calls kept, as a symbol's page lists them.

    The arrays are for pages; joins go by the edges. A symbol that very many call has a row as long as its page.
    """
    ends = calls.select(F.col("src").alias("node"), F.lit(None).cast("string").alias("caller"), F.col("dst").alias("callee"), "ordinal")
    ends = ends.unionByName(calls.select(F.col("dst").alias("node"), F.col("src").alias("caller"), F.lit(None).cast("string").alias("callee"), "ordinal"))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ordinal", c)))), lambda x: x[c]).alias(f"{c}s")
    return ends.groupBy("node").agg(listed("caller"), listed("callee"))


def additional(symbols: DataFrame, others: DataFrame, key: str = "name") -> DataFrame:
    """``symbols`` and those of ``others`` whose key they lack; of others that repeat a key one."""
    return symbols.unionByName(others.dropDuplicates([key]).join(symbols.select(key), key, "left_anti").select(symbols.columns))


def lookup(symbols: DataFrame) -> DataFrame:
    """key, name: short name, full name and file of each symbol (name, file, seq) to its name; the last writer of a key wins."""
    keys = [symbols.select(k.alias("key"), "name", F.col("seq"), F.lit(i).alias("k")) for i, k in enumerate((F.col("name"), text.short_name(F.col("name")), F.col("file")))]
    every = reduce(DataFrame.union, keys).where("key is not null and key <> ''")
    return every.groupBy("key").agg(F.max_by("name", F.struct("seq", "k")).alias("name"))


def resolve_hints(hints: DataFrame, symbols: DataFrame, hint: str = "hint") -> DataFrame:
    """``hints`` with ``target``: the first symbol (name, seq) whose short name the hint is or whose name ends with it; else null.

    A name that ends with a hint has it as one of its tails, so names are joined by their tails that begin at a path's or a name's
    part, which an equi-join does; a hint that begins inside of a part is looked for among the names that end with the same last part.
    """
    h = hints.withColumn("__id", F.monotonically_increasing_id()).withColumn("__hint", F.regexp_replace(F.regexp_replace(F.regexp_replace(hint, r"[{}]", ""), r"^['\" ]+|['\" ]+$", ""), r"\\", "/"))
    last = lambda c: F.regexp_extract(c, r"([^/:]*)$", 1)
    s = symbols.select(F.col("name").alias("__name"), F.col("seq").alias("__seq"), last("name").alias("__last"))
    asked = h.select("__id", "__hint", last("__hint").alias("__last")).where("__hint <> ''")
    # A hint of several parts shares its last part with a target; one of a single part is a tail of the target's last part.
    several = asked.where(F.col("__hint") != F.col("__last")).join(s, "__last").where(F.endswith("__name", "__hint"))
    tails = s.select("__name", "__seq", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("__last"), F.lit(1))), lambda i: F.substr("__last", i))).alias("__hint"))
    single = asked.where((F.col("__hint") == F.col("__last")) & (F.col("__last") != "")).drop("__last").join(tails, "__hint")
    best = several.select("__id", "__name", "__seq").union(single.select("__id", "__name", "__seq")).groupBy("__id").agg(F.min_by("__name", "__seq").alias("target"))
    return h.join(best, "__id", "left").drop("__id", "__hint")


def entry_symbols(entries: DataFrame, symbols: DataFrame) -> DataFrame:
    """type, file, name, symbol of entry points: the first symbol (name, file, seq) of its file, else one whose name holds the file, else one of its name.

    Entry points that none of these finds are left out. Symbols are one row a file and a name before they are joined, so neither many symbols of a
    file nor many entry points in it meet in pairs. A name holds a file if it has it at some place: each name's pieces, of the lengths that files have, are joined with
    the files; the files are broadcast up to 100,000.
    """
    s = symbols.select(F.col("name").alias("__name"), F.col("file").alias("__file"), F.col("seq").alias("__seq"))
    of_file = s.groupBy("__file").agg(F.min_by("__name", "__seq").alias("by_file"))
    first = s.where("__name is not null").groupBy("__name").agg(F.min("__seq").alias("__seq"))
    e = entries.join(of_file, F.col("file") == F.col("__file"), "left").drop("__file")
    rest = checkpointed(e.where("by_file is null and file <> ''").select("file").distinct())
    lengths = rest.agg(F.sort_array(F.collect_set(F.length("file"))).alias("__lengths"))
    pieces = F.flatten(F.transform("__lengths", lambda n: F.transform(
        F.when(n <= F.length("__name"), F.sequence(F.lit(1), F.length("__name") - n + 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda i: F.substr("__name", i, n)
    )))
    held = first.join(F.broadcast(lengths), F.lit(True)).select("__name", "__seq", F.explode(F.array_distinct(pieces)).alias("__piece"))  # one row
    few = F.broadcast(rest) if rest.count() <= 100_000 else rest
    holds = held.join(few, F.col("__piece") == F.col("file")).groupBy(F.col("file").alias("__file")).agg(F.min_by("__name", "__seq").alias("by_part"))
    every = e.join(holds, (F.col("file") == F.col("__file")) & F.col("by_file").isNull(), "left").drop("__file")
    every = every.join(first.select("__name"), F.col("name") == F.col("__name"), "left")
    return every.select("type", "file", "name", F.coalesce("by_file", "by_part", "__name").alias("symbol")).where("symbol is not null")


def real_files(paths: DataFrame, files: DataFrame) -> DataFrame:
    """file, path: each wanted file's real path, the file of that path or else the first with its base name."""
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    same = paths.select("file").distinct()
    first = files.groupBy(base("path").alias("__base")).agg(F.min("path").alias("__by_base"))
    both = same.join(files.select(F.col("path").alias("__path")).distinct(), F.col("file") == F.col("__path"), "left")
    return both.join(first, base("file") == F.col("__base"), "left").select("file", F.coalesce("__path", "__by_base").alias("path"))


def resolved_words(expressions: DataFrame, registry: DataFrame, states: DataFrame) -> DataFrame:
    """id, word, value, source of each word of an expression (id, expression) that is known: a constant, a setting, or else a variable that is CONSTANT.

    ``registry`` has name, value, origin and kind (constant or env), ``states`` id, variable, state, value, source and seq. Text in quotes has no words.
    """
    plain = F.regexp_replace("expression", r"'[^']*'|\"[^\"]*\"", "")
    words = expressions.select("id", F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\$?[a-zA-Z_]\w*"), F.lit(0)))).alias("word"))
    said = registry.select(
        F.col("name").alias("word"), F.col("value"), F.when(F.col("kind") == "env", "env").when(F.col("origin").isNull(), "registry").otherwise(F.concat(F.lit("registry (defined in "), "origin", F.lit(")"))).alias("source"),
        F.when(F.col("kind") == "env", 1).otherwise(0).alias("rank"),
    )
    said = said.groupBy("word").agg(F.min_by(F.struct("value", "source"), "rank").alias("r"))
    own = states.where("state = 'CONSTANT' and value is not null").groupBy("id", F.col("variable").alias("word")).agg(F.min_by(F.struct("value", "source"), "seq").alias("s"))
    both = words.join(said, "word", "left").join(own, ["id", "word"], "left")
    return both.select("id", "word", F.coalesce("r.value", "s.value").alias("value"), F.coalesce("r.source", "s.source").alias("source")).where("value is not null")


def variable_rollup(states: DataFrame) -> DataFrame:
    """behaviour, variable, state, type, constraints: over a behaviour's states (behaviour, variable, state, type, constraints, seq) TAINTED dominates, else the last state; the last known type; all constraints."""
    last = F.max_by("state", "seq")
    return states.groupBy("behaviour", "variable").agg(
        F.when(F.bool_or(F.col("state") == "TAINTED"), "TAINTED").otherwise(F.coalesce(last, F.lit("SAFE"))).alias("state"),
        F.coalesce(F.max_by("type", F.when(F.col("type") != "", F.col("seq"))), F.lit("—")).alias("type"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("constraints")))).alias("constraints"),
    )


def zones(symbols: DataFrame, gates: DataFrame, calls: DataFrame) -> DataFrame:
    """name, zone: gates' callers are authenticated, all other symbols public; a caller that is no symbol is listed too."""
    inner = calls.join(gates.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("name")).distinct()
    outer = symbols.select("name").where("name is not null").distinct().join(inner, "name", "left_anti")
    return inner.select("name", F.lit("AUTHENTICATED").alias("zone")).union(outer.select("name", F.lit("PUBLIC")))


def gate_candidates(states: DataFrame) -> DataFrame:
    """symbol: symbols with a variable (symbol, variable) that is labelled as a credential."""
    return states.where(text.taint_label(F.col("variable")).isin(*GATE_LABELS)).select("symbol").distinct()


def file_report(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """file, symbols, mass, energy, archetypes, lines, bytes: over a file's symbols (file, mass, energy, archetype) and its text (path, content)."""
    per = symbols.where("file is not null").groupBy("file").agg(
        F.count("*").alias("symbols"), F.sum(F.coalesce("mass", F.lit(1.0))).alias("mass"), F.avg(F.coalesce("energy", F.lit(0.0))).alias("energy"),
        F.array_join(F.sort_array(F.collect_set(F.coalesce("archetype", F.lit("generic")))), ",").alias("archetypes"),
    )
    content = F.coalesce("content", F.lit(""))
    whole = F.when(content == "", 0).otherwise(F.regexp_count(content, F.lit("\n")) + F.when(F.endswith(content, F.lit("\n")), 0).otherwise(1))
    size = files.select(F.col("path").alias("file"), whole.cast("long").alias("lines"), F.octet_length(content).cast("long").alias("bytes"))
    return per.join(size, "file", "left").fillna(0, ["lines", "bytes"])


def last_states(states: DataFrame) -> DataFrame:
    """file, variable, state: a file's data model, of a variable the last writer's (file, variable, state, seq)."""
    return states.groupBy("file", "variable").agg(F.max_by("state", "seq").alias("state"))


def links(rows: DataFrame, of: str, to: str, name: str) -> DataFrame:
    """``of`` and the sorted distinct ``to`` of its rows: behaviours of a symbol or file, findings of a symbol."""
    return rows.where(F.col(of).isNotNull()).groupBy(F.trim(of).alias(of)).agg(F.sort_array(F.collect_set(to)).alias(name))


def energy_is_missing(symbols: DataFrame, most: float = 0.8) -> DataFrame:
    """missing: whether more than ``most`` of all symbols have no energy, or there are none: then it has to be computed."""
    return symbols.agg((F.coalesce(F.avg((F.coalesce("energy", F.lit(0.0)) == 0).cast("double")), F.lit(1.0)) > most).alias("missing"))


def coverage(findings: DataFrame) -> DataFrame:
    """rank, cwe, detectable, found of the forty weaknesses, and what share (percent, whole) the scans can find."""
    rows = [(i, f"CWE-{n}", can) for i, (n, can) in enumerate(COVERAGE, 1)]
    table = findings.sparkSession.createDataFrame(rows, "rank int, cwe string, detectable boolean")
    counts = findings.groupBy("cwe").agg(F.count("*").alias("found"))
    share = sum(can for _, can in COVERAGE) * 100 // len(COVERAGE)
    return F.broadcast(table).join(counts, "cwe", "left").select("rank", "cwe", "detectable", F.coalesce("found", F.lit(0)).cast("long").alias("found"), F.lit(share).alias("percent"))


def top_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    """The first critical or high findings by ``seq``."""
    return findings.where(F.upper("severity").isin("CRITICAL", "HIGH")).orderBy("seq").limit(n)


def ranked(df: DataFrame, by: list[Column], n: int, within: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows, of each group of ``within``, with their rank; ``by`` ends with a unique key."""
    if within is None:
        return df.orderBy(*by).limit(n).withColumn("rank", F.row_number().over(W.orderBy(*by)))
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*within).orderBy(*by))).where(F.col("rank") <= n)


def scenario_cap(scenarios: DataFrame, most: int = 8) -> DataFrame:
    """Scenarios (dispatcher, constraints, seq), one for each set of constraints; of a dispatcher with more than ``most`` those of privileged variables come first."""
    one = scenarios.withColumn("set", F.array_sort(F.array_distinct("constraints"))).groupBy("dispatcher", "set").agg(F.min("seq").alias("seq"))
    label = lambda c: text.taint_label(F.regexp_extract(c, r"([\$\w]+)", 1)).isin(*FIRST_LABELS)
    first = F.exists("set", label)
    per = W.partitionBy("dispatcher")
    kept = one.withColumn("n", F.count("*").over(per)).withColumn("rank", F.row_number().over(per.orderBy(F.desc(F.when(F.col("n") > most, first).otherwise(F.lit(False))), "seq")))
    return kept.where(F.col("rank") <= most).select("dispatcher", F.array_join("set", ", ").alias("constraints"), "rank")


def invariants(states: DataFrame) -> DataFrame:
    """symbol, invariant: distinct constraints of variables (symbol, constraints) that are short and plain."""
    return states.select("symbol", F.explode("constraints").alias("invariant")).where((F.length("invariant") < 100) & ~F.col("invariant").rlike("[{};]")).distinct()


def pruned_states(states: DataFrame, flows: DataFrame) -> DataFrame:
    """States (behaviour, state, kind, entry) without made-up redirects and markup, unless they are an entry or the source or sink of a flow (behaviour, source, sink)."""
    touched = flows.select("behaviour", F.explode(F.array("source", "sink")).alias("state")).where("state <> ''").distinct()
    made = (F.col("kind") == "Synthesized") | F.startswith("state", F.lit("[")) | F.startswith("state", F.lit("Redirect:"))
    shown = F.lower(F.trim("state"))
    page = F.startswith(shown, F.lit("<")) | shown.rlike(r"\[redirect\]|redirect:|location:")
    marked = states.join(touched.withColumn("touched", F.lit(True)), ["behaviour", "state"], "left")
    return marked.where(F.coalesce("touched", F.lit(False)) | (F.col("state") == F.col("entry")) | ~(made & page)).drop("touched")


def state_label(state: Column) -> Column:
    """What a made-up state shows: an include, a redirect, a sink with up to 60 characters, or the last part of a path."""
    shown = {
        "echo": "Render Output", "print": "Log/Display", "die": "Terminate", "header": "HTTP Redirect", "mysqli_query": "[(DB)] Query", "mysqli_prepare": "[(DB)] Prepare",
        "mysqli_connect": "[(DB)] Connect", "eval": "🚨 DANGEROUS: Dynamic Eval", "exec": "🚨 DANGEROUS: System Exec", "system": "🚨 DANGEROUS: System Call", "shell_exec": "🚨 DANGEROUS: Shell Exec",
    }
    included = r"(?is)^\[(include|require)(_once)?\]\s*(.*)$"
    part = lambda i: F.regexp_extract(state, included, i)
    out = F.when(state.isNull() | (state == ""), "unknown").when(
        state.rlike(included), F.concat(F.initcap(part(1)), F.when(part(2) != "", " (once)").otherwise(""), F.lit(": "), part(3))
    ).when(F.startswith(state, F.lit("Redirect:")), state)
    for sink, label in shown.items():
        content = F.trim(F.replace(state, F.lit(f"[{sink}]"), F.lit("")))
        cut = F.when(F.length(content) > 60, F.concat(F.substring(content, 1, 60), F.lit("..."))).otherwise(content)
        out = out.when(F.startswith(state, F.lit(f"[{sink}]")), F.concat(F.lit(f"{label}: "), cut)).when(state == sink, F.lit(label))
    return out.otherwise(F.element_at(F.split(state, "/"), -1))


def warnings_index(records: DataFrame, *also: str) -> DataFrame:
    """name, file, warnings (joined) and ``also`` of records that have any."""
    return records.where(F.size("warnings") > 0).select("name", "file", F.array_join("warnings", ", ").alias("warnings"), *also)


def prerequisites(registry: DataFrame) -> DataFrame:
    """name, value, origin of settings, secrets masked."""
    return registry.select("name", text.masked(F.col("name"), F.col("value")).alias("value"), F.coalesce("origin", F.lit("unknown")).alias("origin"))
