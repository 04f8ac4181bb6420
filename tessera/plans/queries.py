"""Registered queries over the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.flow import atoms, systemic, taint
from tessera.functions import docstrings, lint, scores, text
from tessera.operators import beliefs, graph, pages, relational, reports, scans, simulation, traversal, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# ---------------------------------------------------------------- vectors

_SQL_NODES = """n as (select vec_id id, embedding::double[] v, 1 + 0.3 * case when label = 0 then 1.0 else label end + 0.5 * (vec_id % 2) + 2.0 * (vec_id % 5 = 0)::int m,
  embedding[1]::double x, embedding[2]::double y from embeddings)"""
_COS = "list_cosine_similarity(a.v, b.v)"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    m = scores.mass(F.col("label"), F.col("vec_id") % 2, F.col("vec_id") % 5 == 0)
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), m.alias("mass"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query(f"""with {_SQL_NODES}, e as (select a.id, -sum(a.m * b.m / greatest(1 - {_COS}, 1e-5)) energy from n a join n b on a.id <> b.id group by a.id),
c as (select sum(m * x) / sum(m) cx, sum(m * y) / sum(m) cy from n), t as (select max(abs(energy)) top from e),
s as (select id, m mass, energy, 1 / (1 + sqrt((x - cx) ** 2 + (y - cy) ** 2)) cent, 0.7 * (1 - 1 / (1 + exp(-energy / top))) + 0.3 * (1 / (1 + sqrt((x - cx) ** 2 + (y - cy) ** 2))) score from n join e using (id), c, t)
select id, round(mass, 6) mass, round(energy, 6) energy, round(cent, 6) centrality, round(score, 6) score,
case when score >= 0.65 and cent > 0.6 and mass > 2.5 then 'hub' when score >= 0.65 then 'core-logic' when score <= 0.25 then 'utility' else 'standard-module' end archetype from s""")
def energy_scoreboard(spark, d):
    b = vectors.scoreboard(nodes(spark, d))
    return b.select("id", *[F.round(c, 6).alias(c) for c in ("mass", "energy", "centrality", "score")], "archetype")


@query(f"""with {_SQL_NODES}, p as (select a.id, b.id neighbour, round({_COS}, 6) similarity from n a join n b on a.id <> b.id)
select id, rank::int rank, neighbour, similarity from (select *, row_number() over (partition by id order by similarity desc, neighbour) rank from p) where rank <= 3""")
def nearest_neighbors_top3(spark, d):
    return vectors.nearest(nodes(spark, d), 3).select("id", "rank", "neighbour", "similarity")


@query(f"""with {_SQL_NODES}, s as (select a.id query, b.id, round({_COS}, 6) similarity from n a, n b where a.id % 100 = 0), r as (select *, row_number() over (partition by query order by similarity desc, id)::int rank from s)
select query, id, similarity, rank from r where rank <= 10""")
def vector_search_top10(spark, d):
    n = nodes(spark, d)
    return vectors.search(n, n.where("id % 100 = 0"), 10).select("query", "id", "similarity", "rank")


@query(f"""with {_SQL_NODES} select a.id query, b.id, round(a.m * b.m / greatest(1 - {_COS}, 1e-5) ** 2, 6) force, round(a.m * b.m / greatest(1 - {_COS}, 1e-5) ** 2 - 0.1 / greatest(1 - {_COS}, 1e-5), 6) net
from n a, n b where a.id % 100 = 0 and b.id <> a.id and a.m * b.m / greatest(1 - {_COS}, 1e-5) ** 2 > 0.5""")
def entangled_pairs(spark, d):
    n = nodes(spark, d)
    return vectors.entangled(n, n.where("id % 100 = 0")).select("query", "id", F.round("force", 6).alias("force"), F.round("net", 6).alias("net"))


@query(f"""with {_SQL_NODES}, c as (select sum(m * x) / sum(m) cx, sum(m * y) / sum(m) cy from n) select id, round(1 / (1 + sqrt((x - cx) ** 2 + (y - cy) ** 2)), 6) centrality from n, c""")
def centroid_centrality(spark, d):
    return vectors.centrality(nodes(spark, d).drop("vector"), "x", "y", "mass").select("id", F.round("centrality", 6).alias("centrality"))


# ---------------------------------------------------------------- symbols made from orders

# Fixed snippets, dealt by orderkey: known positives and negatives of each scan.
SNIPPETS = (
    "password = 'hunter22'", "while True:\n    work()", "print(user.password)", "log(mask(token))", "requests.get(url)", "requests.get(url, timeout=5)",
    "f = open(path)\nf.write(secret)", "json.dump(hash(token), f)", "@app.route\ndef handler(): pass", "if owner == caller: return 1", "x = 7", "for i in xs:\n    break",
    "max_token = 'abcd'", "auth_key: 'abcd'", "share(password)\nopen(path", "while (true) { go() }", "console.log(api_key)", "logger.info(tokens)", "app.get(path)", "ECHO(x)",
)
_CASE = f"case (o_orderkey % {len(SNIPPETS)}) " + " ".join(f"when {i} then {q(s)}" for i, s in enumerate(SNIPPETS)) + " end"
_SQL_SYMBOLS = f"""symbols as (select 'fn_' || (o_orderkey % 997) || case when o_orderkey % 50 = 0 then '_test' else '' end || case when o_orderkey % 31 = 0 then '_token' else '' end name, 'src/m' || (o_orderkey % 19) || '.py' file, {_CASE} code,
  case when o_orderkey % 3 = 0 then 'public endpoint' else '' end docstring, (o_orderkey % 10) / 10.0::double score, 1.0 + (o_orderkey % 7) / 10.0::double mass, o_orderkey % 11 = 0 exported, o_orderkey from orders),
rules as (select distinct 'fn_' || (l_orderkey % 997) source_function, case l_linenumber % 4 when 0 then 'authorization' when 1 then 'event' when 2 then 'io' else 'validation' end category,
  case l_orderkey % 3 when 0 then 'only the owner' when 1 then 'mask values' else 'writes rows' end description from lineitem)"""


def symbols(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    code = F.element_at(F.array(*map(F.lit, SNIPPETS)), (k % len(SNIPPETS) + 1).cast("int"))
    return o.select(
        F.concat(F.lit("fn_"), (k % 997).cast("string"), F.when(k % 50 == 0, "_test").otherwise(""), F.when(k % 31 == 0, "_token").otherwise("")).alias("name"), F.concat(F.lit("src/m"), (k % 19).cast("string"), F.lit(".py")).alias("file"),
        code.alias("code"), F.when(k % 3 == 0, "public endpoint").otherwise("").alias("docstring"), ((k % 10) / 10.0).cast("double").alias("score"), (1.0 + (k % 7) / 10.0).cast("double").alias("mass"),
        (k % 11 == 0).alias("exported"), k.alias("o_orderkey"), k.alias("seq"),
    )


def rules(spark, d):
    n, x = F.col("l_linenumber"), read(spark, d, "lineitem")
    cat = F.when(n % 4 == 0, "authorization").when(n % 4 == 1, "event").when(n % 4 == 2, "io").otherwise("validation")
    what = F.when(F.col("l_orderkey") % 3 == 0, "only the owner").when(F.col("l_orderkey") % 3 == 1, "mask values").otherwise("writes rows")
    return x.select(F.concat(F.lit("fn_"), (F.col("l_orderkey") % 997).cast("string")).alias("source_function"), cat.alias("category"), what.alias("description")).distinct()


def _scan(cwe, title, severity, where, frm="symbols"):
    return f"select 'CWE-{cwe}' cwe, '{title}' title, name as \"function\", file, {severity} severity from {frm} where {where}"


_SCANS = {
    "missing": _scan(862, "Missing Authorization", "case when score > 0.8 then 'CRITICAL' else 'HIGH' end", r"""not regexp_matches(name, '(?i)^test_|^mock_|_test$|internal_|^calibrate|sync_library') and not contains(lower(file), 'test') and (score > 0.4 or mass > 1.2 or exported)
      and (regexp_matches(code, '@app\.(get|post|put|delete|patch|route)|@router\.|@authorized|@requires|@protected|handler|controller|endpoint|api') or regexp_matches(lower(docstring), 'api|endpoint|handler|request|public') or exported)
      and name not in (select source_function from rules where category = 'authorization')"""),
    "incorrect": _scan(863, "Incorrect Authorization (Potential Bypass)", "'HIGH'", "not regexp_matches(lower(code), '==|!=|if |assert|require|throw|raise')", """(select s.name, s.file, s.code from rules r join (select name, v.file file, v.code code from (select name, arg_min(struct_pack(file := file, code := code), o_orderkey) v from symbols group by name)) s
      on r.source_function = s.name where category = 'authorization' and regexp_matches(lower(description), 'owner|sender|user_id|caller'))"""),
    "exposed": _scan(532, "Sensitive Information Exposure", "'MEDIUM'", "regexp_matches(lower(name || ' ' || docstring), 'password|secret|token|api_key|credential|private_key')", """(select symbols.* from symbols join rules on name = source_function where category in ('event', 'io') and not regexp_matches(lower(description), 'mask|sanitize|hash|strip|redact'))"""),
    "logs": _scan(532, "Sensitive Info in Logs", "'MEDIUM'", r"regexp_matches(code, '(?i)\b(print|log|logger\.|console\.log|error_log)\b') and regexp_matches(code, '(?i)\b(password|secret|token|api_key|credential|private_key)\b') and not regexp_matches(lower(code), 'mask|sanitize|hash|strip|redact')"),
    "credentials": _scan(798, "Hardcoded Credentials", "'CRITICAL'", r"""regexp_matches(code, '(?i)\b(password|secret|api_key|token|credential|auth_key|private_key)\b\s*[:=]\s*["''][^"'']{3,}["'']')"""),
    "loop": _scan(400, "Uncontrolled Resource Consumption (Infinite Loop)", "'HIGH'", r"regexp_matches(code, '\bwhile\s+True\b') and not regexp_matches(code, '\bbreak\b|\breturn\b|\braise\b')"),
    "timeout": _scan(400, "HTTP Request Without Timeout", "'MEDIUM'", "contains(code, 'requests.') and not contains(code, 'timeout=')"),
    "storage": _scan(312, "Cleartext Storage of Sensitive Information", "'HIGH'", r"regexp_matches(code, '(?i)\b(password|secret|token|credential|api_key)\b') and regexp_matches(code, '(?i)\b(open\s*\(|write\s*\(|json\.dump|yaml\.dump|pickle\.dump|sqlite3|INSERT\s+INTO)\b') and not regexp_matches(code, '(?i)\b(hash|bcrypt|sha|pbkdf2|encrypt|AES)\b')"),
}


@query(f"with {_SQL_SYMBOLS} {_SCANS['missing']}")
def missing_authorization(spark, d):
    return scans.missing_authorization(symbols(spark, d), rules(spark, d))


@query(f"with {_SQL_SYMBOLS} {_SCANS['incorrect']}")
def incorrect_authorization(spark, d):
    return scans.incorrect_authorization(symbols(spark, d), rules(spark, d))


@query(r"""select doc_id from documents where regexp_matches(text, '(?i)\b(password|secret|api_key|token|credential|auth_key|private_key)\b\s*[:=]\s*["''][^"'']{3,}["'']')""")
def scan_hardcoded_credentials(spark, d):
    docs = read(spark, d, "documents").select(F.col("text").alias("code"), F.col("doc_id").cast("string").alias("name"), F.col("source").alias("file"))
    return scans.of_code(docs, (scans.hardcoded_credentials,)).select(F.col("function").cast("long").alias("doc_id"))


# Keywords from the longest to the shortest, of equally long ones as they are listed.
_SINK_SQL = "case " + " ".join(f"when regexp_matches(sink, '(?i)(^|[^A-Za-z0-9_]){k}($|[^A-Za-z0-9_])') then {v}" for k, v in (
    ("file_get_contents", 918), ("create_function", 94), ("document[.]write", 79), ("mysqli_query", 89), ("shell_exec", 78), ("subprocess", 78), ("innerHTML", 79), ("setcookie", 614), ("error_log", 532),
    ("passthru", 78), ("execute", 89), ("include", 98), ("require", 98), ("system", 78), ("header", 601), ("print", 79), ("query", 89), ("popen", 78), ("fopen", 22), ("echo", 79), ("exec", 78), ("eval", 94), ("open", 22), ("log", 532),
)) + " end"


@query(f"""with {_SQL_SYMBOLS}, s as (select code sink from symbols), c as (select {_SINK_SQL} weakness from s) select weakness, count(*) n from c where weakness is not null group by weakness""")
def sink_classes(spark, d):
    w = symbols(spark, d).select(scans.sink_weakness(F.col("code")).alias("weakness"))
    return w.where("weakness is not null").groupBy("weakness").agg(F.count("*").alias("n"))


# Warnings of a parser, dealt by orderkey: one for each weakness, one that has none.
PARSER_WARNINGS = (*(f"Line 7: {part.title()}." for part, _, _ in scans.WARNINGS), "Line 7: long line.")
_WARNING_SQL = f"(list_value({', '.join(map(q, PARSER_WARNINGS))}))[o_orderkey % {len(PARSER_WARNINGS)} + 1]"
_WARNED_SQL = "case " + " ".join(f"when contains(lower(warning), '{part}') then {{'cwe': 'CWE-{cwe}', 'severity': '{severity}'}}" for part, cwe, severity in (
    ("sql injection risk", 89, "HIGH"), ("hardcoded credentials", 798, "CRITICAL"), ("insecure deserialization", 502, "HIGH"), ("potential path traversal", 22, "HIGH"), ("use of eval", 94, "CRITICAL"),
    ("aliasing risky functions", 94, "HIGH"), ("debug=true", 1188, "MEDIUM"), ("insecure file permissions", 276, "MEDIUM"), ("unbounded loop", 400, "MEDIUM"), ("memory safety: potential unbounded", 400, "MEDIUM"),
    ("concurrency risk", 362, "MEDIUM"), ("insecure default", 1188, "MEDIUM"), ("blocking call", 400, "LOW"),
)) + " end"
_FLOWS_SQL = f"""select cwe, title, "function", file, severity from (select 'CWE-' || weakness cwe, 'Tainted data reaches a sink' title, arg_min(name, o_orderkey) "function", file, 'CRITICAL' severity
  from (select *, o_orderkey % 90 line, 'v' || (o_orderkey % 7) variable, {_SINK_SQL} weakness from (select *, code sink from symbols)) where o_orderkey % 4 > 0 and weakness is not null group by file, line, variable, weakness)"""
_WARNINGS_SQL = f"""select w.cwe, warning[:80] title, name "function", file, w.severity from (select *, {_WARNED_SQL} w from (select *, {_WARNING_SQL} warning from symbols)) where w is not null"""
_FINDINGS = " union all ".join(f"({x})" for x in (*_SCANS.values(), _FLOWS_SQL, _WARNINGS_SQL))


def findings(spark, d):
    """Of every scan: a flow path, tainted but for each fourth, and a warning for each symbol."""
    s, k = symbols(spark, d), F.col("o_orderkey")
    flows = s.select(F.col("name").alias("function"), "file", (k % 90).alias("line"), F.concat(F.lit("v"), (k % 7).cast("string")).alias("variable"), F.col("code").alias("sink"), F.when(k % 4 > 0, "TAINTED").otherwise("SAFE").alias("state"), k.alias("seq"))
    warning = F.element_at(F.array(*map(F.lit, PARSER_WARNINGS)), (k % len(PARSER_WARNINGS) + 1).cast("int"))
    return scans.all_scans(s, rules(spark, d), flows, s.select("name", "file", warning.alias("warning")))


@query(f"with {_SQL_SYMBOLS} {_FINDINGS}")
def scan_union_report(spark, d):
    return findings(spark, d)


@query(f"""with {_SQL_SYMBOLS}, f as ({_FINDINGS}) select cwe, count(*) n, min(case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end)::int worst,
count(*) filter (where severity = 'CRITICAL') critical, count(*) filter (where severity = 'HIGH') high, count(*) filter (where severity = 'MEDIUM') medium, count(*) filter (where severity = 'LOW') low from f group by cwe""")
def cwe_severity_matrix(spark, d):
    return relational.severity_matrix(findings(spark, d))


# ---------------------------------------------------------------- text

_WORDS = (
    ("validation", "2.0", "valid validate validates check checks verify verifies ensures assert require constraint schema format length range zero null empty invalid sanitize".split()),
    ("authorization", "1.7", "owner only access permission role admin authorize authorized restrict restricted privilege onlyowner requires caller sender whitelist blacklist".split()),
    ("computation", "1.8", "calculate calculates compute computes hash sign encrypt multiply divide sum average aggregate formula interest price score weight balance".split()),
    ("io", "2.0", "fetch read write save load store database db http api request response upload download file stream socket network send receive".split()),
    ("event", "1.3", "emit emits event log logs notify notification trigger dispatch publish broadcast webhook callback".split()),
)
_CAT_SQL = ", ".join(f"round(least(len(list_intersect(w, {ks!r})) / {least}::double, 1.0), 6) \"{c}\"" for c, least, ks in _WORDS)


@query(f"with d as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z_]+')) w from documents) select doc_id, {_CAT_SQL} from d")
def rule_category_scores(spark, d):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z_]+"), F.lit(0))
    s = text.category_scores(F.col("w"))
    return read(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", *[F.round(v, 6).alias(k) for k, v in s.items()])


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) raw from documents), t as (select doc_id, trim(raw, ' ') line from l)
select doc_id, count(*) n_rules, sha256(string_agg(line, chr(10) order by line)) rules from t where length(line) > 10 and regexp_matches(lower(line), 'must|should|ensure|valid|check|verify|only') group by doc_id""")
def keyword_rules(spark, d):
    r = read(spark, d, "documents").select("doc_id", F.sort_array(text.keyword_rules(F.col("text"))).alias("r")).where("size(r) > 0")
    return r.select("doc_id", F.size("r").cast("long").alias("n_rules"), F.sha2(F.array_join("r", "\n").cast("binary"), 256).alias("rules"))


_LANG_SQL = """case when regexp_matches(p, '[.]py$') then 'python' when regexp_matches(p, '[.]jsx?$') then 'javascript' when regexp_matches(p, '[.]tsx?$') then 'typescript' when regexp_matches(p, '[.]sol$') then 'solidity' when regexp_matches(p, '[.]go$') then 'go'
when regexp_matches(p, '[.]rs$') then 'rust' when regexp_matches(p, '[.]java$') then 'java' when regexp_matches(p, '[.]rb$') then 'ruby' when regexp_matches(p, '[.]php$') then 'php' when regexp_matches(p, '[.](c|cpp|h|hpp|cc|cxx)$') then 'cpp'
when regexp_matches(p, '[.]ya?ml$') then 'yaml' when regexp_matches(p, '[.]toml$') then 'toml' when regexp_matches(p, '[.]json$') then 'json' else 'generic' end"""


@query(f"""with s as (select page_id, regexp_replace(url, '[?#].*$', '') || (['.py', '.tsx', '.go', '.h', '.yml', '', '.PY'])[page_id % 7 + 1] p from pages) select page_id, {_LANG_SQL} lang from s""")
def language_detect(spark, d):
    suffix = F.element_at(F.array(*map(F.lit, [".py", ".tsx", ".go", ".h", ".yml", "", ".PY"])), (F.col("page_id") % 7 + 1).cast("int"))
    path = F.concat(F.regexp_replace("url", "[?#].*$", ""), suffix)
    return read(spark, d, "pages").select("page_id", text.language_of(path).alias("lang"))


_DEPS = """l as (select page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) target from pages), t as (select *, case when page_id % 4 = 0 then 'APICall' when page_id % 4 = 1 then 'RelativeImport' else 'ExternalImport' end kind, case when page_id % 3 = 0 then '.' || target else target end tgt from l),
c as (select *, case when lower(kind) like '%api%' or lower(kind) like '%http%' or starts_with(lower(tgt), 'http://') or starts_with(lower(tgt), 'https://') then 'api' when starts_with(lower(tgt), './') or starts_with(lower(tgt), '../') then 'internal' when lower(kind) like '%relative%' then 'internal' else 'external' end dep_type from t)"""


def dependencies(spark, d):
    links = read(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    p = F.col("page_id")
    links = links.withColumn("kind", F.when(p % 4 == 0, "APICall").when(p % 4 == 1, "RelativeImport").otherwise("ExternalImport"))
    links = links.withColumn("tgt", F.when(p % 3 == 0, F.concat(F.lit("."), F.col("target"))).otherwise(F.col("target")))
    return links.withColumn("dep_type", text.dependency_type(F.col("kind"), F.col("tgt")))


@query(f"with {_DEPS} select page_id, tgt target, dep_type from c")
def dependency_links(spark, d):
    return dependencies(spark, d).select("page_id", F.col("tgt").alias("target"), "dep_type")


@query(f"with {_DEPS} select coalesce(nullif(url, ''), 'unknown') file, dep_type, count(*) n, count(distinct tgt) targets from c group by all")
def dependency_summary(spark, d):
    file = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.lit("unknown")).alias("file")
    return dependencies(spark, d).groupBy(file, "dep_type").agg(F.count("*").alias("n"), F.countDistinct("tgt").alias("targets"))


_LABEL_SQL = "case " + " ".join(f"when regexp_matches(n, '{p}') then '{v}'" for p, v in (
    (r"\buser[-_]?id\b", "USER_ID"), (r"\bsession[-_]?id\b", "SESSION_ID"), (r"\btoken\b", "AUTH_TOKEN"), (r"\bpassword|passwd\b", "CREDENTIAL"), (r"\border[-_]?id\b", "RESOURCE_ID"), (r"\bquery\b", "SQL_SINK"),
    (r"\bcmd|command\b", "CMD_SINK"), (r"\bfile[-_]?path|filename\b", "PATH_SINK"), (r"\bheader\b", "HTTP_HEADER"), (r"\binput\b", "USER_INPUT"), (r"\bpayload\b", "USER_INPUT"),
    (r"\bprice|amount|total\b", "FINANCIAL_VALUE"), (r"\brole|permission\b", "PRIVILEGE_LABEL"),
)) + " else 'GENERIC_TAINT' end"


@query(f"""with w as (select unnest(['$user_id', 'session-id', 'csrf token', 'passwd2', 'my query', 'filename', 'header', 'xs', 'total_price', 'role']) w), s as (select event_id, ltrim(lower(w.w), '$') n from events, w)
select {_LABEL_SQL} label, n, count(*) hits from s group by all""")
def taint_labels(spark, d):
    names = ["$user_id", "session-id", "csrf token", "passwd2", "my query", "filename", "header", "xs", "total_price", "role"]
    e = read(spark, d, "events").select("event_id", F.explode(F.array(*map(F.lit, names))).alias("w"))
    return e.select(text.taint_label(F.col("w")).alias("label"), F.ltrim(F.lower("w"), F.lit("$")).alias("n")).groupBy("label", "n").agg(F.count("*").alias("hits"))



# ---------------------------------------------------------------- relations

# Every document, by id: a quarter each only in the old snapshot, only in the new one, in both alike, and in both with the new text edited.


def snapshots(spark, d):
    docs, k = read(spark, d, "documents"), F.pmod("doc_id", F.lit(4))
    edited = F.when(k == 3, F.concat("text", F.lit(" // edited"))).otherwise(F.col("text"))
    return docs.where(k != 1).select(F.col("doc_id").alias("path"), F.col("text").alias("content")), docs.where(k != 0).select(F.col("doc_id").alias("path"), edited.alias("content"))


@query("""with o as (select doc_id path, text content from documents where doc_id % 4 <> 1), n as (select doc_id path, case when doc_id % 4 = 3 then text || ' // edited' else text end content from documents where doc_id % 4 <> 0)
select coalesce(o.path, n.path) path, case when o.path is null then 'added' when n.path is null then 'deleted' when o.content = n.content or trim(o.content, ' ') = '' or trim(n.content, ' ') = '' then 'same' else 'modified' end change
from o full join n on o.path = n.path""")
def branch_diff(spark, d):
    old, new = snapshots(spark, d)
    return relational.snapshot_diff(old, new, "path", "content").select("path", "change")


@query("""with e as (select distinct l_suppkey s, l_partkey d from lineitem), o as (select s node, count(*) fan_out, 0 fan_in from e group by s union all select d, 0, count(*) from e group by d)
select node, sum(fan_out)::bigint fan_out, sum(fan_in)::bigint fan_in from o group by node""")
def call_fan_in_out(spark, d):
    return graph.fan(read(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("""select l_partkey node, count(distinct l_suppkey) callers, round(least(1.0, count(distinct l_suppkey) / 10), 6) gate_confidence from lineitem group by l_partkey having count(distinct l_suppkey) >= 2""")
def auth_gates(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.gates(e, F.lit(True)).withColumn("gate_confidence", F.round("gate_confidence", 6))


_EDGES = "e as (select distinct c_custkey src, (c_custkey * 7 + c_nationkey) % 1000 dst from customer)"


def edges(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 7 + F.col("c_nationkey")) % 1000).alias("dst"))


def every_node(e: DataFrame) -> DataFrame:
    return e.select("src").union(e.select("dst")).distinct()


@query(f"""with recursive {_EDGES}, r(start, node, depth) as (select src, src, 0 from (select src from e union select dst from e) union select start, dst, depth + 1 from r join e on node = src where depth < 3)
select start, node, (['direct', 'secondary', 'tertiary'])[min(depth)] ring from r group by start, node having min(depth) > 0""")
def blast_radius(spark, d):
    e = edges(spark, d)
    return graph.blast_radius(e, every_node(e))


@query(f"""with recursive {_EDGES}, b as (select src, dst from e union select dst, src from e), r(start, node, depth) as (select distinct src, src, 0 from b union select start, b.dst, depth + 1 from r join b on node = b.src where depth < 3)
select start, node, min(depth)::int depth from r group by all having min(depth) > 0""")
def call_path_trace(spark, d):
    e = edges(spark, d)
    return graph.reach(e, every_node(e), 3, "both")


@query("""select event_id id, first(event_id) over w root, (row_number() over w - 1)::int hops from events window w as (partition by user_id order by ts, event_id)""")
def lineage_chain(spark, d):
    from pyspark.sql import Window as W

    parent = F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return graph.lineage(read(spark, d, "events").select(F.col("event_id").alias("id"), parent.alias("parent")))


@query("""select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) where r = 1""")
def evidence_latest(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return relational.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""select event_id, lead(event_id) over (partition by user_id order by ts, event_id) superseded_by, case when lead(event_id) over (partition by user_id order by ts, event_id) is null then 'active' else 'superseded' end status from events""")
def evidence_superseded(spark, d):
    return relational.superseded(read(spark, d, "events"), "event_id", "user_id", "ts").select("event_id", "superseded_by", "status")


@query("""with l as (select user_id, event_type, max(ts) last from events group by all) select user_id, event_type, r::int recency, r > 3 evicted from (select *, row_number() over (partition by user_id order by last desc, event_type) r from l)""")
def lru_evicted(spark, d):
    return relational.recency_eviction(read(spark, d, "events"), "user_id", "event_type", "ts", 3).select("user_id", "event_type", "recency", "evicted")




def observations(spark, d):
    kinds = F.array(*map(F.lit, ["view", "signup", "purchase", "error", "click"]))
    kind = F.element_at(F.array(*map(F.lit, beliefs.ARCHETYPES)), F.array_position(kinds, F.col("event_type")).cast("int"))
    return read(spark, d, "events").select("user_id", "ts", "event_id", kind.alias("kind"), (0.5 + (F.col("event_id") % 5) / 10).alias("weight"), (0.6 + (F.col("event_id") % 4) / 10).alias("trust"))



@query("""select l_orderkey, l_linenumber, round(l_discount * ln(1 + l_quantity) * abs(l_tax) * 0.5 * 0.9, 6) activation, round((l_quantity * l_discount * 2 - 1) / greatest(l_tax, 1e-5), 4) debt, round(0.5 * l_discount + 0.25 * l_tax + 0.15 * 0.3 + 0.1 * 0.2, 6) drift,
0.5 * l_discount + 0.25 * l_tax + 0.15 * 0.3 + 0.1 * 0.2 > 0.1 flagged, round(least(greatest(0.1 + 0.8 * l_discount, 0.1), 0.9), 6) rate from lineitem""")
def cognitive_metrics(spark, d):
    c = F.col
    drift = scores.drift(c("l_discount"), c("l_tax"), F.lit(0.3), F.lit(0.2))
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(scores.activation(c("l_discount"), c("l_quantity"), c("l_tax"), F.lit(0.5), F.lit(0.9)), 6).alias("activation"),
        F.round(scores.attention_debt(c("l_quantity"), c("l_discount"), F.lit(2.0), F.lit(1.0), c("l_tax")), 4).alias("debt"), F.round(drift, 6).alias("drift"), (drift > 0.1).alias("flagged"), F.round(scores.learning_rate(c("l_discount")), 6).alias("rate"),
    )


@query("""select o_orderkey, case when o_orderkey % 13 = 0 then 0 else 10 * (o_orderpriority = '1-URGENT')::int + 6 * (o_orderstatus = 'F')::int + 5 * (o_totalprice > 100000)::int + 3 * (o_orderkey % 4) end::bigint relevance from orders""")
def commit_relevance(spark, d):
    k = F.col("o_orderkey")
    r = scores.relevance(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000, k % 4, k % 13 == 0)
    return read(spark, d, "orders").select("o_orderkey", r.cast("long").alias("relevance"))


@query("""select p_type archetype, count(*) n, round(sum(p_retailprice), 2) mass, count(*) filter (where p_size > 40) tainted, round(avg(p_size), 6) energy, count(distinct p_brand) behaviours from part group by p_type""")
def archetype_rollup(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_type").alias("archetype")).agg(
        F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("mass"), F.count_if(F.col("p_size") > 40).alias("tainted"), F.round(F.avg("p_size"), 6).alias("energy"), F.countDistinct("p_brand").alias("behaviours"),
    )


@query("select p_partkey, p_retailprice, row_number() over (order by p_retailprice desc, p_partkey)::int rank from part order by p_retailprice desc, p_partkey limit 10")
def hotspots(spark, d):
    return relational.top_k(read(spark, d, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 10)


@query("""select o_custkey, o_orderkey, r::int rank from (select *, row_number() over (partition by o_custkey order by (o_orderpriority = '1-URGENT') desc, o_orderkey) r from orders) where r <= 8""")
def priority_cap(spark, d):
    o = read(spark, d, "orders")
    return relational.top_k(o, [F.desc(F.col("o_orderpriority") == "1-URGENT"), F.col("o_orderkey")], 8, ["o_custkey"]).select("o_custkey", "o_orderkey", "rank")


@query("""select coalesce(c_custkey, s_suppkey) id, coalesce(s_name, c_name) name, coalesce(s_acctbal, c_acctbal) balance from customer full join supplier on c_custkey = s_suppkey""")
def cognitive_merge(spark, d):
    g = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return relational.merged(g, s, "id", ["name", "balance"])


@query("""with s as (select 'f' || (o_orderkey % 7) || ':fn' || (o_orderkey % 12000) name from orders), u as (select split_part(name, ':', 2) short, count(*) n, min(name) name from s group by short) select short, name from u where n = 1""")
def short_name_lookup(spark, d):
    k = F.col("o_orderkey")
    s = read(spark, d, "orders").select(F.concat(F.lit("f"), (k % 7).cast("string"), F.lit(":fn"), (k % 12000).cast("string")).alias("name"))
    return relational.unique_short_names(s)


@query("select event_type, time_bucket(interval '1 hour', ts) as start, count(*) n, round(sum(value), 2) total from events group by all")
def session_activity(spark, d):
    from tessera.streaming.jobs import activity

    return activity(read(spark, d, "events"), "1 hour")


@query(r"""with d as (select p_partkey, p_brand, p_partkey % 2 = 0 js, case when p_partkey % 2 = 0 then concat('/** Must check ', p_name, chr(10), ' * @param {string} brand ', p_brand, chr(10), ' * @return {number} size ', p_size)
  else concat('@dev of ', p_type, chr(10), '@notice Pays ', p_name, chr(10), '@param brand ', p_brand, chr(10), '@return ok ', p_size) end doc from part),
r as (select *, case when js then 'brand:string:' else 'brand::' end || regexp_extract(doc, '@param (?:\{\w+\} )?brand ([^\n]*)', 1) params, regexp_extract(doc, '@return (?:\{(\w+)\})?', 1) || ':' || regexp_extract(doc, '@return (?:\{\w+\}|ok) ([^\n]*)', 1) returned,
  case when js then regexp_extract(doc, '(Must [^\n]*)', 1) else regexp_extract(doc, '@notice ([^\n]*)', 1) || '; ' || regexp_extract(doc, '@dev ([^\n]*)', 1) end rules from d)
select p_partkey, params, returned, rules, p_brand || '(brand) — ' || trim(regexp_replace(doc, '[*/]+', '', 'g')) || ' Rules: ' || rules genome from r""")
def docstring_genomes(spark, d):
    k, text_of = F.col("p_partkey"), lambda *parts: F.concat(*[F.col(p).cast("string") if p.startswith("p_") else F.lit(p) for p in parts])
    doc = F.when(k % 2 == 0, text_of("/** Must check ", "p_name", "\n * @param {string} brand ", "p_brand", "\n * @return {number} size ", "p_size")).otherwise(
        text_of("@dev of ", "p_type", "\n@notice Pays ", "p_name", "\n@param brand ", "p_brand", "\n@return ok ", "p_size")
    )
    language = F.when(k % 2 == 0, "javascript").otherwise("solidity")
    p = read(spark, d, "part").select(k, "p_brand", doc.alias("doc"), language.alias("language"))
    x = p.withColumns({f.__name__: f(F.col("doc"), F.col("language")) for f in (docstrings.params, docstrings.returns, docstrings.rules)})
    return x.select(
        k, F.array_join(F.transform("params", lambda q: F.concat_ws(":", q["name"], q["type"], q["description"])), "|").alias("params"),
        F.concat_ws(":", "returns.type", "returns.description").alias("returned"), F.array_join("rules", "; ").alias("rules"),
        docstrings.genome(F.col("p_brand"), F.lit("brand"), F.col("doc"), F.col("rules")).alias("genome"),
    )


@query()  # a walk in queue order; tested against one with a queue
def behaviour_map(spark, d):
    x = read(spark, d, "lineitem")
    at = F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal")
    e = x.groupBy((F.col("l_suppkey") % 97).alias("src"), (F.col("l_partkey") % 97).alias("dst"), F.concat(F.lit("flag == '"), "l_returnflag", F.lit("'")).alias("condition")).agg(at)
    return traversal.behaviour(e, e.select(F.col("src").alias("start")), scenario=("flag == 'N'",))


# ---------------------------------------------------------------- lint

# Records, dealt by orderkey, and below in SQL the rules that each breaks: written down by hand, from the rules.
LINT_CASES = (
    ("get_x", "(a)", "", "src/a.py", "x1 = cursor.execute('a' + b + 'c')\nrows = eval(raw)"),
    ("fetch_rows", "(a, b, c, d, e)", "Args:\n  a (int): one", "src/components/button.tsx", "rows = db.select('*')"),
    ("load_file", "(a, f(b, c), 'd, e', [f, g], {h: i})", "Loads", "src/hooks/state.ts", "let x = fetch(path)\nlist.push(path)"),
    ("save_all", "(request)", "Saves all", "src/api/getUser/list.ts", "res.json(body)\nnote: any"),
    ("run", "()", "Runs", "a.py", "try:\n    go()\nexcept ValueError: pass\nos.chmod(path, 0o777)\nglobal total"),
    ("check", "()", "Checks", "a.py", "async def work():\n    time.sleep(1)\n    await one()\n    await two()"),
    ("update", "()", "Updates", "a.py", "for item in items:\n    found.append(item)\n# increment the count\ncount += 1"),
    ("create", "()", "Creates", "a.py", "password = 'hunter22'\nDEBUG = True\nkey = requests.get(url)"),
    ("handle", "()", "Handles", "a.py", "while True:\n    work()\n" + " " * 16 + "deep()\nwait = 1\nwait = 37"),
    ("start", "()", "Starts", "a.js", "setCount(count + 1)\ntry { go() } catch (e) {}\nv = a ? b : c ? d : e"),
    ("calculator", "()", "Does", "a.py", "@lru_cache\ndef calc(is_open=True): return pickle.loads(raw)"),
    ("stop", "()", "Stops", "a.py", "# only a comment: eval(x), SELECT *\nruns = evaluate(x)"),
    ("read_it", "()", "Reads", "a.py", "\n".join(f"line{chr(97 + i % 26)}()" for i in range(51)) + "\n"),
    ("parse", "()", "Parses", "a.py", "with open(base + \"/\") as handle:\n    pass\nexec_alias = exec"),
)
_LINT_SQL = """(values (0, 'LR-11'), (0, 'LR-12'), (0, 'LR-15'), (0, 'LR-37'), (1, 'LR-01'), (1, 'LR-02'), (1, 'LR-05'), (1, 'LR-38'), (2, 'LR-03'), (2, 'LR-29'), (2, 'LR-30'), (2, 'LR-31'), (2, 'LR-38'),
  (3, 'LR-04'), (3, 'LR-06'), (3, 'LR-07'), (3, 'LR-10'), (3, 'LR-38'), (4, 'LR-18'), (4, 'LR-21'), (4, 'LR-24'), (5, 'LR-22'), (5, 'LR-35'), (6, 'LR-23'), (6, 'LR-34'),
  (7, 'LR-13'), (7, 'LR-14'), (7, 'LR-16'), (8, 'LR-17'), (8, 'LR-28'), (8, 'LR-32'), (9, 'LR-08'), (9, 'LR-09'), (9, 'LR-29'), (9, 'LR-33'), (10, 'LR-19'), (10, 'LR-25'), (10, 'LR-26'), (10, 'LR-36'), (12, 'LR-27'), (13, 'LR-12'), (13, 'LR-20'), (13, 'LR-31')) v(k, rule)"""


def lint_records(spark, d):
    k = F.col("o_orderkey") % len(LINT_CASES)
    field = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in LINT_CASES]), (k + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", *[field(i).alias(n) for i, n in enumerate(("name", "signature", "docstring", "path", "code"))])


def _record_columns():
    return {c: F.col(c) for c in ("code", "name", "signature", "docstring", "path")} | {"kind": F.lit("Function"), "language": text.language_of(F.col("path"))}


@query(f"select rule, count(*) n from orders join {_LINT_SQL} on o_orderkey % {len(LINT_CASES)} = k group by rule")
def lint_symbols(spark, d):
    s = lint_records(spark, d)
    return lint.by_record(s, _record_columns(), lint.broken, "rules").select(F.explode("rules").alias("rule"), "n").groupBy("rule").agg(F.sum("n").alias("n"))


@query(r"""with p as (select doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', '', 'g'), '(?s)"{3}\s*.*?\s*"{3}', '', 'g'), '(?s)''{3}\s*.*?\s*''{3}', '', 'g'), '//[^\n]*', '', 'g'), '#[^\n]*', '', 'g') plain from documents)
select doc_id, regexp_matches(plain, '\bglobal\s+\w+') lr24, len(string_split_regex(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r')) > 50 and text <> '' lr27, regexp_matches(plain, '(?i)\b(password|secret|api_key|token|credential|auth_key)\b\s*[:=]\s*[''"][^''"]{3,}[''"]') lr13,
regexp_matches(plain, '\bos\.chmod\s*\([^\n]*?(0o777|777|0777)\b') lr21 from p""")
def lint_text_rules(spark, d):
    r = lint.findings(code=F.col("text"), name=F.lit("get"), signature=F.lit(""), docstring=F.lit("x"), path=F.lit(""), kind=F.lit("Function"), language=F.lit("python"))
    return read(spark, d, "documents").select("doc_id", *[(F.size(r[f"LR-{n}"]) > 0).alias(f"lr{n}") for n in (24, 27, 13, 21)])


@query()  # texts of warnings; tested rule by rule
def warnings_index(spark, d):
    s = lint_records(spark, d).withColumn("file", F.col("path"))
    every = reports.warnings_index(lint.by_record(s, _record_columns(), lint.warnings, "warnings", ("name", "file")), "n")
    return every.groupBy("name", "file", "warnings").agg(F.sum("n").alias("records"))


# ---------------------------------------------------------------- PHP: atoms, taint, calls

# Fixed snippets, dealt by orderkey, and below in SQL what is in each, by hand. A comparison is an assignment too, which ends the condition before it.
PHP = (
    "$id = $_GET['id'];\necho $id;\n", "$a = 'x';\necho $a;\n", "$q = htmlspecialchars($_POST['q']);\nprint $q;\n", "$n = $_COOKIE['n'];\nif ($n == 'admin') {\n    run($n);\n}\n",
    "switch ($level) { case 'low': $p = 'a.php'; break; case 'high': $p = 'b.php'; break; }\ninclude $p;\n", "function show($t) {\n    helper($t);\n}\n", "define('ROOT', 'www');\n// echo $_GET['x'];\n",
)
_ATOMS_SQL = """(values (0, 'global_state', 1), (0, 'usage', 1), (0, 'assignment', 1), (0, 'sink', 1), (1, 'assignment', 1), (1, 'sink', 1), (2, 'global_state', 1), (2, 'usage', 1), (2, 'assignment', 1), (2, 'call', 1), (2, 'sink', 1),
  (3, 'global_state', 1), (3, 'usage', 1), (3, 'assignment', 2), (3, 'condition', 1), (3, 'call', 1), (3, 'delimiter', 2), (4, 'condition', 3), (4, 'usage', 1), (4, 'assignment', 2), (4, 'interrupt', 2), (4, 'delimiter', 2), (4, 'synthesized_call', 1),
  (5, 'assignment', 1), (5, 'call', 2), (5, 'delimiter', 2), (6, 'constant', 1), (6, 'call', 1)) v(k, type, each)"""
_FLOWS_OF_PHP = """(values (0, 'echo', '$id', 'TAINTED', '$_GET', 2, ''), (2, 'print', '$q', 'SAFE', '$_POST', 2, ''),
  (3, 'if ($n == ''admin'')', '$n', 'TAINTED', '$_COOKIE', 2, '$n == ''admin'''), (3, 'run', '$n', 'TAINTED', '$_COOKIE', 3, ''), (3, 'run', '$n', 'TAINTED', '$_COOKIE', 3, '$n == ''admin'''),
  (5, 'show', '$t', 'TAINTED', 'external', 1, ''), (5, 'helper', '$t', 'TAINTED', 'external', 2, '')) v(k, sink, variable, state, source, line, constraints)"""


def php_symbols(spark, d):
    k = F.col("o_orderkey")
    code = F.element_at(F.array(*map(F.lit, PHP)), (k % len(PHP) + 1).cast("int"))
    return read(spark, d, "orders").select(k.alias("symbol"), F.concat(F.lit("src/p"), (k % 19).cast("string"), F.lit(".php")).alias("file"), code.alias("code"), F.lit("php").alias("language"))


@query(f"select type, sum(each)::bigint n from orders join {_ATOMS_SQL} on o_orderkey % {len(PHP)} = k group by type")
def php_atoms(spark, d):
    return atoms.atoms(php_symbols(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


@query(f"select o_orderkey symbol, sink, variable, state, source, line, constraints from orders join {_FLOWS_OF_PHP} on o_orderkey % {len(PHP)} = k")
def taint_paths(spark, d):
    f = taint.flow_paths(taint.analysed(php_symbols(spark, d)))
    return f.select("symbol", "sink", "variable", "state", "source", "line", F.array_join("constraints", ", ").alias("constraints"))


@query(f"""select o_orderkey symbol, 'include' verb, resolved, constraints from orders, (values ('a.php', '$level == ''low'''), ('b.php', '$level == ''high''')) v(resolved, constraints) where o_orderkey % {len(PHP)} = 4""")
def synthesized_calls(spark, d):
    c = taint.synthesized_calls(taint.analysed(php_symbols(spark, d)))
    return c.select("symbol", "verb", "resolved", F.array_join("constraints", ", ").alias("constraints"))


@query(f"""with f as (select {_SINK_SQL.replace('sink', 'lower(sink)')} weakness, 'src/p' || (o_orderkey % 19) || '.php' file, line, variable, o_orderkey from orders join {_FLOWS_OF_PHP} on o_orderkey % {len(PHP)} = k where state = 'TAINTED')
select 'CWE-' || weakness cwe, file, min(o_orderkey) "function" from f where weakness is not null group by weakness, file, line, variable""")
def taint_to_sink(spark, d):
    f = taint.flow_paths(taint.analysed(php_symbols(spark, d))).select(F.col("symbol").alias("function"), "file", "line", "variable", "sink", "state", F.col("symbol").alias("seq"))
    return scans.tainted_sinks(f).select("cwe", "file", "function")


# A chain of calls in each group of five orders: a page takes an id and hands it on by position; the last one echoes it, unless it is cleaned on the way.
def call_chain(spark, d):
    k = F.col("o_orderkey")
    name = lambda i: F.concat(F.lit("f"), ((F.floor(k / 5) * 5) + i).cast("string"))
    code = (
        F.when(k % 5 == 0, F.concat(F.lit("$id = $_GET['id'];\n"), name(1), F.lit("('x', $id);\n"))).when(k % 5 == 1, F.concat(F.lit("$z = $b;\n"), name(2), F.lit("($b);\n")))
        .when(k % 5 == 2, F.concat(F.lit("$y = $c;\n"), name(3), F.lit("(1, $c);\n"))).when(k % 5 == 3, F.lit("$w = $e;\necho $e;\n")).otherwise(F.lit("echo 'end';\n"))
    )
    signature = F.when(k % 5 == 1, "($a, $b)").when(k % 5 == 2, "($c)").when(k % 5 == 3, "($d, $e = 'f, g')").otherwise("()")
    rows = read(spark, d, "orders").select(name(k % 5).alias("symbol"), F.lit("p.php").alias("file"), code.alias("code"), F.lit("php").alias("language"), signature.alias("signature"), k)
    calls = rows.where("o_orderkey % 5 < 3").select(F.col("symbol").alias("src"), F.concat(F.lit("f"), (k + 1).cast("string")).alias("dst"), k.alias("ordinal"))
    return rows, calls, rows.where("o_orderkey % 5 = 0").select(F.col("symbol").alias("start"))


@query("""with g as (select o_orderkey - o_orderkey % 5 k, count(*) filter (where o_orderkey % 5 < 4) n from orders group by all having bool_or(o_orderkey % 5 = 0))
select 'f' || k "start", 1 step, 'f' || k || ' -> f' || (k + 1) || ' -> f' || (k + 2) || ' -> f' || (k + 3) path, '$e' variable, 'echo' sink, 'DYNAMIC' state, 'HIGH' severity from g where n = 4""")
def systemic_taint(spark, d):
    rows, calls, starts = call_chain(spark, d)
    return systemic.trace(taint.analysed(rows, signature="signature"), calls, starts)


# ---------------------------------------------------------------- physics


@query()  # a simulation; tested against plain loops
def calibration_grid(spark, d):
    c = simulation.calibrate(nodes(spark, d).select("id", "vector", "mass"))
    return c.select("g", "k", *[F.round(x, 6).alias(x) for x in ("business", "utility", "error")], "best")


@query()  # a simulation; tested against plain loops
def simulated_positions(spark, d):
    return simulation.simulate(nodes(spark, d).select("id", "vector", "mass"), 20)


# ---------------------------------------------------------------- reports and their joins

_SYM = """sym as (select o_orderkey seq, 'm' || (o_orderkey % 19) || '.py' file, 'm' || (o_orderkey % 19) || '.py:fn_' || (o_orderkey % 997) name, case when o_orderkey % 4 = 0 then null else 1 + (o_orderkey % 7) / 10.0::double end mass,
  case when o_orderkey % 3 = 0 then null else -(o_orderkey % 11)::double end energy, (['hub', 'utility', 'core-logic'])[o_orderkey % 3 + 1] archetype from orders)"""


# Order numbers and lines repeat; with the price they tell rows apart.
_SEQ = "((l_orderkey * 8 + l_linenumber) * 100000000 + floor(l_extendedprice * 100 + 0.5)::bigint)"


def _seq():
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000000 + F.floor(F.col("l_extendedprice") * 100 + 0.5)


def report_symbols(spark, d):
    k = F.col("o_orderkey")
    file = F.concat(F.lit("m"), (k % 19).cast("string"), F.lit(".py"))
    kinds = F.element_at(F.array(*map(F.lit, ("hub", "utility", "core-logic"))), (k % 3 + 1).cast("int"))
    return read(spark, d, "orders").select(
        k.alias("seq"), file.alias("file"), F.concat(file, F.lit(":fn_"), (k % 997).cast("string")).alias("name"), F.when(k % 4 != 0, 1 + (k % 7) / F.lit(10.0)).cast("double").alias("mass"),
        F.when(k % 3 != 0, -(k % 11).cast("double")).alias("energy"), kinds.alias("archetype"),
    )


_CALLS = """calls as (select l_orderkey * 8 + l_linenumber ordinal, case when l_suppkey % 13 > 0 then 'fn_' || (l_suppkey % 97) end caller, 'm' || (l_suppkey % 5) || '.py' caller_file, 'fn_' || (l_partkey % 97) callee, case when l_partkey % 17 > 0 then 'm' || (l_partkey % 5) || '.py' else '' end callee_file from lineitem)"""


def raw_calls(spark, d):
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    fn, file = lambda x: F.concat(F.lit("fn_"), (x % 97).cast("string")), lambda x: F.concat(F.lit("m"), (x % 5).cast("string"), F.lit(".py"))
    return read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"), F.when(s % 13 > 0, fn(s)).alias("caller"), file(s).alias("caller_file"), fn(p).alias("callee"), F.when(p % 17 > 0, file(p)).otherwise("").alias("callee_file"),
    )


@query(f"with {_CALLS} select caller_file || ':' || caller src, callee_file || ':' || callee dst, count(*) n from calls where caller is not null and callee_file <> '' group by all")
def qualified_calls(spark, d):
    return reports.qualified_calls(raw_calls(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"""with {_CALLS}, e as (select ordinal, caller_file || ':' || caller src, callee_file || ':' || callee dst from calls where caller is not null and callee_file <> ''),
c as (select src node, count(*) n_callees, sha256(string_agg(dst, ',' order by ordinal, dst)) callees from e group by src), r as (select dst node, count(*) n_callers, sha256(string_agg(src, ',' order by ordinal, src)) callers from e group by dst)
select coalesce(c.node, r.node) node, coalesce(n_callers, 0) n_callers, coalesce(n_callees, 0) n_callees, coalesce(callers, sha256('')) callers, coalesce(callees, sha256('')) callees from c full join r on c.node = r.node""")
def call_adjacency(spark, d):
    raw = raw_calls(spark, d)
    both = (F.col("caller").isNotNull()) & (F.col("callee_file") != "")
    e = raw.where(both).select("ordinal", F.concat_ws(":", "caller_file", "caller").alias("src"), F.concat_ws(":", "callee_file", "callee").alias("dst"))
    a = reports.adjacency(e)
    size, digest = (lambda c: F.size(c).cast("long")), (lambda c: F.sha2(F.array_join(c, ",").cast("binary"), 256))
    return a.select("node", size("callers").alias("n_callers"), size("callees").alias("n_callees"), digest("callers").alias("callers"), digest("callees").alias("callees"))


@query(f"with {_SYM}, k as (select name key, name, seq, 0 k from sym union all select split_part(name, ':', 2), name, seq, 1 from sym union all select file, name, seq, 2 from sym) select key, arg_max(name, struct_pack(seq := seq, k := k)) name from k group by key")
def name_lookup(spark, d):
    return reports.lookup(report_symbols(spark, d))


@query(f"""with {_SYM}, h as (select p_partkey, (['fn_' || (p_partkey % 1500), 'm' || (p_partkey % 30) || '.py:fn_' || (p_partkey % 997), '{{_' || (p_partkey % 997) || '}}', 'py:fn_' || p_partkey])[p_partkey % 4 + 1] hint from part),
c as (select *, trim(trim(regexp_replace(hint, '[{{}}]', '', 'g')), '''" ') clean from h),
n as (select name, split_part(name, ':', 2) short, min(seq) seq from sym group by all), t as (select clean, arg_min(name, seq) target from (select distinct clean from c) join n on n.short = clean or ends_with(n.name, clean) group by clean)
select p_partkey, target from c left join t using (clean)""")
def call_hints(spark, d):
    k = F.col("p_partkey")
    s = lambda x: x.cast("string")
    hint = F.element_at(F.array(F.concat(F.lit("fn_"), s(k % 1500)), F.concat(F.lit("m"), s(k % 30), F.lit(".py:fn_"), s(k % 997)), F.concat(F.lit("{_"), s(k % 997), F.lit("}")), F.concat(F.lit("py:fn_"), s(k))), (k % 4 + 1).cast("int"))
    symbols_ = report_symbols(spark, d).groupBy("name").agg(F.min("seq").alias("seq"))
    return reports.resolve_hints(read(spark, d, "part").select("p_partkey", hint.alias("hint")), symbols_).select("p_partkey", "target")


@query(f"""with {_SYM}, e as (select s_suppkey, 'x' type, (['m' || (s_suppkey % 40) || '.py', 'fn_' || (s_suppkey % 9) || '.zz', '.py:fn_' || s_suppkey, 'none'])[s_suppkey % 4 + 1] file, 'm' || (s_suppkey % 19) || '.py:fn_' || (s_suppkey % 997) name from supplier),
a as (select s_suppkey, arg_min(sym.name, seq) s from e join sym using (file) group by all), b as (select s_suppkey, arg_min(sym.name, seq) s from e join sym on contains(sym.name, e.file) group by all), c as (select s_suppkey, min(sym.name) s from e join sym on sym.name = e.name group by all)
select e.file, e.name, coalesce(a.s, b.s, c.s) symbol from e left join a using (s_suppkey) left join b using (s_suppkey) left join c using (s_suppkey) where coalesce(a.s, b.s, c.s) is not null""")
def entry_symbols(spark, d):
    k = F.col("s_suppkey")
    s = lambda x: x.cast("string")
    file = F.element_at(F.array(F.concat(F.lit("m"), s(k % 40), F.lit(".py")), F.concat(F.lit("fn_"), s(k % 9), F.lit(".zz")), F.concat(F.lit(".py:fn_"), s(k)), F.lit("none")), (k % 4 + 1).cast("int"))
    e = read(spark, d, "supplier").select(F.lit("x").alias("type"), file.alias("file"), F.concat(F.lit("m"), s(k % 19), F.lit(".py:fn_"), s(k % 997)).alias("name"))
    return reports.entry_symbols(e, report_symbols(spark, d)).select("file", "name", "symbol")


@query(f"""with {_SYM}, f as (select 'm' || (p_partkey % 25) || '.py' path, string_agg(p_name, chr(10) order by p_partkey) content from part group by p_partkey % 25)
select file, count(*) symbols, round(sum(coalesce(mass, 1.0)), 6) mass, round(avg(coalesce(energy, 0.0)), 6) energy, string_agg(distinct archetype, ',' order by archetype) archetypes, coalesce(any_value(len(string_split(content, chr(10)))), 0)::bigint lines, coalesce(any_value(octet_length(encode(content))), 0)::bigint bytes
from sym left join f on path = file group by file""")
def file_report(spark, d):
    p = read(spark, d, "part").groupBy((F.col("p_partkey") % 25).alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), "\n").alias("content"))
    files = p.select(F.concat(F.lit("m"), F.col("k").cast("string"), F.lit(".py")).alias("path"), "content")
    r = reports.file_report(report_symbols(spark, d), files)
    return r.select("file", "symbols", F.round("mass", 6).alias("mass"), F.round("energy", 6).alias("energy"), "archetypes", "lines", "bytes")


@query(f"with {_SYM} select avg((coalesce(energy, 0.0) = 0)::int) > 0.8 missing from sym")
def energy_gate(spark, d):
    return reports.energy_is_missing(report_symbols(spark, d))


@query(f"""with s as (select l_suppkey behaviour, 'v' || (l_partkey % 7) variable, (['SAFE', 'TAINTED', 'DYNAMIC', 'CONSTANT'])[l_orderkey % 4 + 1] state, case when l_linenumber % 2 = 0 then l_returnflag else '' end type, ['c' || l_linenumber, l_linestatus] constraints, {_SEQ} seq from lineitem)
select behaviour, variable, case when bool_or(state = 'TAINTED') then 'TAINTED' else arg_max(state, seq) end state, coalesce(arg_max(type, seq) filter (where type <> ''), '—') type, list_sort(list_distinct(flatten(list(constraints))))::varchar constraints from s group by all""")
def variable_rollup(spark, d):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    state = F.element_at(F.array(*map(F.lit, ("SAFE", "TAINTED", "DYNAMIC", "CONSTANT"))), (k % 4 + 1).cast("int"))
    s = read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("behaviour"), F.concat(F.lit("v"), (F.col("l_partkey") % 7).cast("string")).alias("variable"), state.alias("state"), F.when(n % 2 == 0, F.col("l_returnflag")).otherwise("").alias("type"),
        F.array(F.concat(F.lit("c"), n.cast("string")), "l_linestatus").alias("constraints"), _seq().alias("seq"),
    )
    return reports.variable_rollup(s).withColumn("constraints", F.concat(F.lit("["), F.array_join("constraints", ", "), F.lit("]")))


# Variables of symbols, dealt by partkey: one in eleven holds a credential.
_HELD = ("$x", "$total", "$session-id", "$n", "$query", "$price", "$name", "$role", "$y", "$input", "$z")


@query(f"""with h as (select distinct l_partkey node, (list_value({', '.join(map(q, _HELD))}))[l_partkey % 11 + 1] variable from lineitem), c as (select node from h where regexp_matches(variable, '\\bsession[-_]?id\\b|\\btoken\\b|\\bpassword|passwd\\b')),
g as (select l_partkey node from lineitem join c on node = l_partkey group by all having count(distinct l_suppkey) >= 2), a as (select distinct l_suppkey s from lineitem where l_partkey in (select node from g))
select s as name, 'AUTHENTICATED' zone from a union all select s_suppkey, 'PUBLIC' from supplier where s_suppkey not in (select s from a)""")
def privilege_zones(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    held = e.select(F.col("dst").alias("symbol"), _deal(F.col("dst"), *_HELD).alias("variable"))
    inward = e.join(reports.gate_candidates(held).withColumnRenamed("symbol", "dst"), "dst", "left_semi")
    return reports.zones(read(spark, d, "supplier").select(F.col("s_suppkey").alias("name")), graph.gates(inward, F.lit(True)), e)


@query(f"with {_SQL_SYMBOLS}, f as ({_FINDINGS}), c as (select cwe, count(*) found from f group by cwe) select rank, v.cwe, detectable, coalesce(found, 0) found, 55 percent from (" + """
  select unnest(range(1, 41)) rank, 'CWE-' || unnest([79, 787, 89, 352, 22, 125, 78, 416, 862, 434, 94, 20, 77, 287, 269, 502, 200, 863, 918, 119, 476, 798, 190, 400, 306, 770, 668, 74, 427, 639, 532, 732, 601, 362, 522, 276, 203, 59, 843, 312]) cwe,
  list_contains([1, 3, 5, 7, 9, 11, 13, 16, 17, 18, 19, 22, 24, 25, 28, 30, 31, 32, 33, 34, 36, 40], unnest(range(1, 41))) detectable""" + ") v left join c on c.cwe = v.cwe")
def cwe_coverage(spark, d):
    return reports.coverage(findings(spark, d))


@query("""with s as (select o_custkey dispatcher, list_sort(list_distinct([case when o_orderkey % 5 = 0 then '$role' else '$x' end || ' == ''' || (o_orderkey % 6) || '''', '$y == ''' || (o_orderkey % 3) || ''''])) cs, o_orderkey seq from orders),
o as (select dispatcher, cs, min(seq) seq from s group by all), n as (select *, count(*) over (partition by dispatcher) n, array_to_string(cs, ', ') c from o),
r as (select *, row_number() over (partition by dispatcher order by (n > 8 and contains(c, '$role')) desc, seq)::int rank from n) select dispatcher, c constraints, rank from r where rank <= 8""")
def scenario_cap(spark, d):
    k = F.col("o_orderkey")
    one = F.concat(F.when(k % 5 == 0, "$role").otherwise("$x"), F.lit(" == '"), (k % 6).cast("string"), F.lit("'"))
    s = read(spark, d, "orders").select(F.col("o_custkey").alias("dispatcher"), F.array(one, F.concat(F.lit("$y == '"), (k % 3).cast("string"), F.lit("'"))).alias("constraints"), k.alias("seq"))
    return reports.scenario_cap(s)


@query(f"with {_SYM} select name, mass, rank::int rank, archetype from (select *, row_number() over (partition by archetype order by mass desc nulls last, seq) rank from sym) where rank <= 10")
def key_symbols(spark, d):
    return reports.ranked(report_symbols(spark, d), [F.desc_nulls_last("mass"), F.col("seq")], 10, ["archetype"]).select("name", "mass", "rank", "archetype")


@query(f"""with {_SYM}, s as (select name, archetype, coalesce(mass, 1.0) mass, coalesce(energy, 0.0) energy from sym), r as (select *, row_number() over (partition by archetype order by mass desc, name, energy) rank from s),
t as (select archetype, string_agg('- [[symbols/' || regexp_replace(name, '[^a-zA-Z0-9_-]', '_', 'g') || '\\|' || split_part(name, ':', -1) || ']] (mass ' || printf('%.2f', mass) || ', energy ' || printf('%.2f', energy) || ')', chr(10) order by rank) top from r where rank <= 10 group by 1)
select 'narratives/' || archetype || '.md' path, '# Subsystem: ' || archetype || chr(10) || chr(10) || printf('%d symbols with a mass of %.2f together.', count(*), sum(mass)) || chr(10) || '## Key symbols' || chr(10) || chr(10) || any_value(top) || chr(10) content
from s join t using (archetype) group by archetype""")
def narrative_pages(spark, d):
    return pages.narratives(report_symbols(spark, d))


@query(f"with {_SYM} select name, energy, (row_number() over (order by energy desc, seq))::int rank from (select * replace (coalesce(energy, 0.0) as energy) from sym) order by energy desc, seq limit 10")
def attention_hotspots(spark, d):
    s = report_symbols(spark, d).withColumn("energy", F.coalesce("energy", F.lit(0.0)))
    return reports.ranked(s, [F.desc("energy"), F.col("seq")], 10).select("name", "energy", "rank")


@query(f"""with {_SQL_SYMBOLS}, s as (select *, o_orderkey seq from symbols) select name as "function", 'CWE-798' cwe from s where regexp_matches(code, '(?i)\\b(password|secret|api_key|token|credential|auth_key|private_key)\\b\\s*[:=]\\s*["''][^"'']{{3,}}["'']') order by seq limit 5""")
def top_findings(spark, d):
    s = symbols(spark, d)
    f = s.select("seq", F.inline(F.array_compact(F.array(scans.hardcoded_credentials(), scans.sensitive_in_logs()))))
    return reports.top_findings(f).select("function", "cwe")


_RULE_WORDS = ", ".join(f"({i}, '{c}', {ks!r}, {least})" for i, (c, least, ks) in enumerate(_WORDS))


@query(rf"""with w as (select doc_id, text, list_distinct(string_split_regex(lower(text), '[^0-9A-Za-z_]+')) ws from documents), k(i, category, ks, least) as (values {_RULE_WORDS}),
s as (select doc_id, category, i, least(len(list_intersect(ws, ks)) / least, 1.0)::double score from w, k), b as (select doc_id, arg_max(category, struct_pack(a := score, b := -i)) category, max(score) score from s group by doc_id)
select doc_id source_function, category, sha256(regexp_replace(text[:200], '^\s+|\s+$', '', 'g')) description, round(least(score, 0.6), 6) confidence from b join documents using (doc_id) where score > 0""")
def document_rules(spark, d):
    r = read(spark, d, "documents").select(F.inline(text.rules_of(F.col("doc_id"), F.expr("cast(array() as array<string>)"), F.col("text"), F.lit(""))))
    return r.select("source_function", "category", F.sha2(F.col("description").cast("binary"), 256).alias("description"), F.round("confidence", 6).alias("confidence"))


@query(f"""with {_SQL_SYMBOLS.split('rules as')[0].rstrip().rstrip(',')}, r as (select 'fn_' || (l_orderkey % 997) symbol, (['io', 'event'])[l_linenumber % 2 + 1] category, (l_quantity / 50)::double confidence, {_SEQ} seq from lineitem),
l as (select symbol, arg_max(category, seq) category, arg_max(confidence, seq) confidence from r group by symbol) select symbol, category, round(confidence, 6) support, case when confidence > 0.8 then 'ACTIVE' else 'SUPERPOSITION' end status, case when confidence > 0.8 then category end winner from l""")
def rule_beliefs(spark, d):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    category = F.element_at(F.array(F.lit("io"), F.lit("event")), (n % 2 + 1).cast("int"))
    r = read(spark, d, "lineitem").select(F.concat(F.lit("fn_"), (k % 997).cast("string")).alias("source_function"), category.alias("category"), (F.col("l_quantity") / 50).cast("double").alias("confidence"), _seq().alias("seq"))
    return beliefs.of_rules(r).select("symbol", F.element_at(F.map_keys("belief"), 1).alias("category"), F.round("support", 6).alias("support"), "status", "winner")


_BAG = "list_transform(range(64), lambda i: len(list_filter(list_transform(list_filter(string_split_regex(lower({0}[:2000]), '[^\\pL\\pN]+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 8))::bigint % 64), lambda x: x = i))::double)"


@query(f"""with d as (select doc_id, text, doc_id % 4 k from documents), o as (select doc_id path, text content from d where k <> 1), n as (select doc_id path, case when k = 3 then text || ' // edited' when k = 2 then reverse(text) else text end content from d where k <> 0),
e as (select o.path, {_BAG.format('o.content')} a, {_BAG.format('n.content')} b from o join n using (path) where o.content <> n.content and regexp_matches(o.content, '\\S') and regexp_matches(n.content, '\\S')),
s as (select path, 1 - case when list_sum(a) * list_sum(b) = 0 then 0.0 else list_cosine_similarity(a, b) end distance from e) select path, round(distance, 6) distance from s where distance >= 0.25""")
def branch_drift(spark, d):
    docs, k = read(spark, d, "documents"), F.pmod("doc_id", F.lit(4))
    new = F.when(k == 3, F.concat("text", F.lit(" // edited"))).when(k == 2, F.reverse("text")).otherwise(F.col("text"))
    old, new = docs.where(k != 1).select(F.col("doc_id").alias("path"), F.col("text").alias("content")), docs.where(k != 0).select(F.col("doc_id").alias("path"), new.alias("content"))
    return vectors.drifted(old, new, vectors.hashed_embedding).select("path", F.round("distance", 6).alias("distance"))


@query("select l_orderkey, l_linenumber, case when l_quantity / 8 > 5 then 4 when l_quantity / 8 > 2 then 2 else 0 end n_actions from lineitem")
def probing_actions(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.size(beliefs.probing_actions(F.col("l_quantity") / 8)).alias("n_actions"))


# Beliefs in SQL: one step after another along a user's events; the floor is taken five times.
def _floor(p: str) -> str:
    return f"(select case when c = 0 or c = 5 then q else list_transform(q, lambda x: case when x <= 0.01 then 0.01 else x * (1 - 0.01 * c) / r end) end from (select q, len(list_filter(q, lambda x: x <= 0.01)) c, list_sum(list_filter(q, lambda x: x > 0.01)) r from (select {p} q)))"


_STEP = "list_transform(range(1, 6), lambda i: r.p[i] * case when i = o.kind then 1 + o.tw else 1 - o.tw / 2 end)"
_RAW = f"(select list_transform(z, lambda x: x / list_sum(z)) from (select {_STEP} z))"
_FOLDED = _RAW
for _ in range(5):
    _FOLDED = _floor(_FOLDED)
_BELIEFS = f"""o as (select user_id, list_position(['view', 'signup', 'purchase', 'error', 'click'], event_type) kind, (0.5 + (event_id % 5) / 10) * (0.6 + (event_id % 4) / 10) tw, 0.6 + (event_id % 4) / 10 t, row_number() over (partition by user_id order by ts, event_id) k from events),
r(user_id, k, p, support) as (select distinct user_id, 0::bigint, [0.2::double, 0.2, 0.2, 0.2, 0.2], 0.0::double from o union all select r.user_id, o.k, {_FOLDED}, r.support + o.t from r join o on o.user_id = r.user_id and o.k = r.k + 1)"""


@query(f"""with recursive {_BELIEFS}, l as (select user_id, max(k) n, arg_max(p, k) p, arg_max(support, k) support from r group by user_id), s as (select *, list_reverse_sort(p) s from l)
select user_id, round(p[1], 6) gate, round(p[2], 6) sink, round(p[3], 6) transform, round(p[4], 6) io, round(p[5], 6) storage, round(support, 6) support, n::int n, case when n >= 3 and s[1] > 0.8 and s[1] - s[2] > 0.2 then 'ACTIVE' else 'SUPERPOSITION' end status,
case when n >= 3 and s[1] > 0.8 and s[1] - s[2] > 0.2 then (['Gate', 'Sink', 'Transform', 'IO', 'Storage'])[list_position(p, s[1])] end winner from s""")
def belief_fold(spark, d):
    f = beliefs.collapse(beliefs.fold(observations(spark, d), "user_id", "kind", "weight", "trust", ["ts", "event_id"]))
    return f.select("user_id", *[F.round(F.col("probabilities")[i], 6).alias(a.lower()) for i, a in enumerate(beliefs.ARCHETYPES)], F.round("support", 6).alias("support"), "n", "status", "winner")


@query(f"with recursive {_BELIEFS} select user_id, k::int n, round(p[1], 6) gate, round(support, 6) support from r where k > 0")
def belief_timeline(spark, d):
    t = beliefs.timeline(observations(spark, d), "user_id", "kind", "weight", "trust", ["ts", "event_id"])
    return t.select("user_id", "n", F.round(F.col("probabilities")[0], 6).alias("gate"), F.round("support", 6).alias("support"))


@query("""with w as (select event_id, value, user_id, event_type, lag(value) over (partition by user_id, event_type order by ts, event_id) before from events) select event_id, round(value - before, 6) moved from w""")
def cached_drift(spark, d):
    return relational.drift_from_cached(read(spark, d, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"]).select("event_id", F.round("moved", 6).alias("moved"))


@query(r"""with f as (select 'src/p' || page_id || (['.js', '.py', '.php', '.txt'])[page_id % 4 + 1] path, (['app.listen (3)', 'if __name__ == "__main__": go()', '<?php require "a.php";', 'x'])[page_id % 4 + 1] c from pages
  union all select 'src/' || (['main.py', 'index.php', 'config.inc.php', '.env.dist', 'other.py'])[page_id % 5 + 1], 'x' from pages where page_id < 5)
select distinct case when regexp_matches(path, '/(main.py|index.php)$') then 'fallback' when regexp_matches(path, 'p[0-9]+[.](js|py|php)$') then 'heuristic' else 'setup_config' end type, path file, regexp_extract(path, '([^/.]*)[^/]*$', 1) as name from f where regexp_matches(path, 'p[0-9]+[.](js|py|php)$|/(main[.]py|index[.]php|config[.]inc[.]php|[.]env[.]dist)$')
union all select * from (values ('package.json', 'lib/a.js', 'main'), ('package.json', 'bin/b.js', 'tool'), ('pyproject.toml', 'pkg.cli:run', 'go'))""")
def entrypoints_found(spark, d):
    from tessera.sources import entrypoints

    k = F.col("page_id")
    pick = lambda i, *xs: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    p = read(spark, d, "pages")
    first = p.select(F.concat(F.lit("src/p"), k.cast("string"), pick(k % 4, ".js", ".py", ".php", ".txt")).alias("path"), pick(k % 4, "app.listen (3)", 'if __name__ == "__main__": go()', '<?php require "a.php";', "x").alias("content"))
    second = p.where("page_id < 5").select(F.concat(F.lit("src/"), pick(k % 5, "main.py", "index.php", "config.inc.php", ".env.dist", "other.py")).alias("path"), F.lit("x").alias("content"))
    config = spark.createDataFrame([("package.json", '{"main": "lib/a.js", "bin": {"tool": "bin\\\\b.js"}}'), ("pyproject.toml", '[project.scripts]\ngo = "pkg.cli:run"\n'), ("Cargo.toml", "broken [")], "path string, content string")
    return entrypoints.entrypoints(first.union(second).distinct().union(config))


@query(f"""select o_orderkey::varchar src, dst from orders join (values (0, '[echo] $id'), (1, '[echo] $a'), (2, '[print] $q'), (4, '[include] $p')) v(k, dst) on o_orderkey % {len(PHP)} = k""")
def made_up_states(spark, d):
    return atoms.made_up_states(atoms.atoms(php_symbols(spark, d))).select("src", "dst")


# ---------------------------------------------------------------- names, labels, settings, states


def _deal(key, *values):
    """The value that a key deals from a list."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


@query(r"""with p as (select p_partkey, 'src/' || p_brand || (['.py', '.md', '/README', '.lock', '/package-lock.json'])[p_partkey % 5 + 1] file, case when p_partkey % 3 = 0 then 'x:' else '' end || p_name as name,
  ([['Function', 'Class'], ['Variable', 'Enum'], ['Module'], [], ['Method', 'Interface'], ['Other']])[p_partkey % 6 + 1] labels, (['api_key', 'host', 'PASSWORD', 'port'])[p_partkey % 4 + 1] setting, (['''a''', '[1]', 'array(1)', 'new A', 'TRUE', '1.5', '$x', '', '1.2.3', ' ''b'])[p_partkey % 10 + 1] literal,
  (['Log the query', 'Needs permission', 'Reads a file', 'Validates it', 'Plain', 'EVENT'])[p_partkey % 6 + 1] said from part)
select p_partkey, case when list_contains(labels, 'Class') then 'Class' when list_contains(labels, 'Interface') then 'Interface' when list_contains(labels, 'Enum') then 'Enum' when list_contains(labels, 'Variable') then 'Variable' when list_contains(labels, 'Method') then 'Method'
  when list_contains(labels, 'Function') then 'Function' when list_contains(labels, 'Module') then 'Module' else 'Function' end kind, case when contains(name, ':') then name else file || ':' || name end qualified,
 trim(regexp_replace(file, '[^A-Za-z0-9]+', '-', 'g'), '-') slug, case when length(repeat(name, 5)) > 60 then regexp_replace(repeat(name, 5), '[^a-zA-Z0-9_-]', '_', 'g')[:50] || '_' || md5(repeat(name, 5))[:6] else regexp_replace(repeat(name, 5), '[^a-zA-Z0-9_-]', '_', 'g') end safe,
 case when setting in ('api_key', 'PASSWORD') then '********' else p_partkey::varchar end shown, case literal when '''a''' then 'string' when '[1]' then 'array' when 'array(1)' then 'array' when 'new A' then 'object' when 'TRUE' then 'boolean' when '1.5' then 'number' when '' then 'unknown' else 'dynamic' end literal,
 case said when 'Log the query' then 'event' when 'EVENT' then 'event' when 'Needs permission' then 'authorization' when 'Reads a file' then 'io' when 'Validates it' then 'validation' else 'generic' end category,
 regexp_matches(lower(file), '[.](md|json|txt|ya?ml|lock|log)$|readme|changelog|license|contributors|authors') or regexp_matches(lower(name), 'readme|changelog|license|contributors|authors') documentation,
 ends_with(file, '.md') or ends_with(file, '/package-lock.json') ignored from p""")
def symbol_texts(spark, d):
    k = F.col("p_partkey")
    labels = F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in (("Function", "Class"), ("Variable", "Enum"), ("Module",), (), ("Method", "Interface"), ("Other",))]), (k % 6 + 1).cast("int"))
    p = read(spark, d, "part").select(
        k, F.concat(F.lit("src/"), "p_brand", _deal(k, ".py", ".md", "/README", ".lock", "/package-lock.json")).alias("file"), F.concat(F.when(k % 3 == 0, "x:").otherwise(""), "p_name").alias("name"), labels.alias("labels"),
        _deal(k, "api_key", "host", "PASSWORD", "port").alias("setting"), _deal(k, "'a'", "[1]", "array(1)", "new A", "TRUE", "1.5", "$x", "", "1.2.3", " 'b").alias("literal"),
        _deal(k, "Log the query", "Needs permission", "Reads a file", "Validates it", "Plain", "EVENT").alias("said"),
    )
    return p.select(
        "p_partkey", text.kind_of(F.col("labels")).alias("kind"), text.qualified(F.col("file"), F.col("name")).alias("qualified"), text.slug(F.col("file")).alias("slug"), text.safe_name(F.repeat("name", F.lit(5))).alias("safe"),
        text.masked(F.col("setting"), F.col("p_partkey").cast("string")).alias("shown"), text.literal_type(F.col("literal")).alias("literal"), text.inline_category(F.col("said")).alias("category"),
        text.is_documentation(F.col("file"), F.col("name")).alias("documentation"), text.ignored(F.col("file")).alias("ignored"),
    )


_STATES = ("[include_once] a/b.php", "[require] c", "Redirect: /x", "[echo] " + "y" * 70, "[mysqli_query] $q", "die", "src/a/b.php", "main", "[redirect] z", "<b>location: w", "[eval] code")


@query(f"""with s as (select o_orderkey, (list_value({', '.join(map(q, _STATES))}))[o_orderkey % {len(_STATES)} + 1] state from orders)
select o_orderkey, case o_orderkey % {len(_STATES)} when 0 then 'Include (once): a/b.php' when 1 then 'Require: c' when 2 then 'Redirect: /x' when 3 then 'Render Output: ' || repeat('y', 60) || '...' when 4 then '[(DB)] Query: $q' when 5 then 'Terminate' when 6 then 'b.php'
 when 7 then 'main' when 8 then '[redirect] z' when 9 then '<b>location: w' when 10 then '🚨 DANGEROUS: Dynamic Eval: code' end as label from s""")
def state_labels(spark, d):
    return read(spark, d, "orders").select("o_orderkey", reports.state_label(_deal(F.col("o_orderkey"), *_STATES)).alias("label"))


@query(f"""with s as (select o_custkey behaviour, (list_value({', '.join(map(q, _STATES))}))[o_orderkey % {len(_STATES)} + 1] state, o_orderkey from orders), f as (select distinct o_custkey behaviour, 'Redirect: /x' state from orders where o_orderkey % 7 = 0)
select behaviour, s.state, count(*) n from s left join f using (behaviour, state) where f.state is not null or s.state = 'main' or s.state not in ('Redirect: /x', '[redirect] z', '<b>location: w') or s.state = '<b>location: w' and behaviour % 2 = 0 group by all""")
def pruned_states(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    state = _deal(k, *_STATES)
    kind = F.when(F.startswith(state, F.lit("<")) & (F.col("o_custkey") % 2 == 1), "Synthesized").otherwise("Function")
    s = o.select(F.col("o_custkey").alias("behaviour"), state.alias("state"), kind.alias("kind"), F.lit("main").alias("entry"))
    flows = o.where(k % 7 == 0).select(F.col("o_custkey").alias("behaviour"), F.lit("Redirect: /x").alias("source"), F.lit("").alias("sink"))
    return reports.pruned_states(s, flows).groupBy("behaviour", "state").agg(F.count("*").alias("n"))


@query("""with e as (select o_orderkey id, o_orderkey % 25 c, o_orderkey % 7 v from orders), n as (select n_nationkey c, 'C' || n_nationkey as word, n_name as value, case when n_nationkey % 2 = 0 then 'registry (defined in f' || n_regionkey || '.php)' else 'env' end source from nation)
select id, word, value, source from e join n using (c) union all select id, '$v' || v, 'x' || id, 'internal' from e where v < 4""")
def resolved_words(spark, d):
    k = F.col("o_orderkey")
    e = read(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("C"), (k % 25).cast("string"), F.lit(" . 'C1 $v0' . $v"), (k % 7).cast("string")).alias("expression"))
    n = F.col("n_nationkey")
    registry = read(spark, d, "nation").select(F.concat(F.lit("C"), n.cast("string")).alias("name"), F.col("n_name").alias("value"), F.concat(F.lit("f"), F.col("n_regionkey").cast("string"), F.lit(".php")).alias("origin"), F.when(n % 2 == 0, "constant").otherwise("env").alias("kind"))
    states = read(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("$v"), (k % 7).cast("string")).alias("variable"), F.when(k % 7 < 4, "CONSTANT").otherwise("TAINTED").alias("state"), F.concat(F.lit("x"), k.cast("string")).alias("value"), F.lit("internal").alias("source"), k.alias("seq"))
    return reports.resolved_words(e, registry, states)


@query("""with w as (select distinct 'm' || (o_orderkey % 30) || '/f' || (o_orderkey % 50) || '.py' file from orders), f as (select distinct 'm' || (p_partkey % 20) || '/f' || (p_partkey % 40) || '.py' path from part), b as (select split_part(path, '/', 2) base, min(path) first from f group by base)
select file, coalesce(f.path, b.first) path from w left join f on f.path = w.file left join b on b.base = split_part(w.file, '/', 2)""")
def real_files(spark, d):
    at = lambda k, a, b: F.concat(F.lit("m"), (k % a).cast("string"), F.lit("/f"), (k % b).cast("string"), F.lit(".py"))
    return reports.real_files(read(spark, d, "orders").select(at(F.col("o_orderkey"), 30, 50).alias("file")), read(spark, d, "part").select(at(F.col("p_partkey"), 20, 40).alias("path")))


@query("""select 'KEY_' || c_nationkey as name, max_by('v=' || c_custkey, c_custkey) as value, 'd' || c_nationkey || '/.env' origin from customer group by c_nationkey""")
def env_settings(spark, d):
    from tessera.sources import readers

    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    line = F.concat(F.lit("# c\n\n KEY_"), n, F.lit(" = 'v="), k.cast("string"), F.lit("'\nBAD"))
    files = read(spark, d, "customer").groupBy(n.alias("n")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k, line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))
    return readers.settings(files.select(F.concat(F.lit("d"), "n", F.lit("/.env")).alias("path"), "content"))


@query("""with e as (select *, event_id % 2 part from events), r as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by ts desc, part desc, event_id desc) r from e) select user_id, event_type, value from r where r = 1""")
def upserted(spark, d):
    from tessera.sources import readers

    e = read(spark, d, "events").select("user_id", "event_type", "ts", "value", "event_id")
    both = readers.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["ts"])
    return both.select("user_id", "event_type", "value")


@query("""select l_suppkey::varchar symbol, 'a == ' || l_linenumber invariant from lineitem where l_linenumber <= 3 union select l_suppkey::varchar, l_returnflag from lineitem where l_returnflag <> 'R'""")
def invariants(spark, d):
    n = F.col("l_linenumber")
    c = F.array(F.when(n > 3, F.lit("x" * 100)).otherwise(F.concat(F.lit("a == "), n.cast("string"))), F.when(F.col("l_returnflag") == "R", "{r}").otherwise(F.col("l_returnflag")))
    return reports.invariants(read(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), c.alias("constraints")))


@query("select l_suppkey::varchar file, 'v' || (l_partkey % 9) variable, arg_max(l_returnflag, " + _SEQ + ") state from lineitem group by all")
def last_states(spark, d):
    s = read(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("file"), F.concat(F.lit("v"), (F.col("l_partkey") % 9).cast("string")).alias("variable"), F.col("l_returnflag").alias("state"), _seq().alias("seq"))
    return reports.last_states(s)


@query("select l_suppkey::varchar symbol, array_to_string(list_sort(list_distinct(list(l_shipdate::date::varchar))), ',') findings from lineitem group by l_suppkey")
def findings_of_symbols(spark, d):
    rows = read(spark, d, "lineitem").select(F.concat(F.lit(" "), F.col("l_suppkey").cast("string")).alias("symbol"), F.col("l_shipdate").cast("date").cast("string").alias("f"))
    return reports.links(rows, "symbol", "f", "findings").select("symbol", F.array_join("findings", ",").alias("findings"))


@query(f"""with recursive {_BELIEFS}, l as (select user_id, max(k) n, arg_max(p, k) p from r group by user_id), s as (select *, list_reverse_sort(p) s from l), w as (select *, case when n >= 3 and s[1] > 0.8 and s[1] - s[2] > 0.2 then (['Gate', 'Sink', 'Transform', 'IO', 'Storage'])[list_position(p, s[1])] end w from s)
select user_id, round(1 - s[1], 6) uncertainty, user_id || ' is ' || coalesce(w, 'undecided') || ' (' || case when w is null then 'superposition' else 'active' end || ') after ' || n || ' observations' prose from w""")
def belief_context(spark, d):
    f = beliefs.collapse(beliefs.fold(observations(spark, d), "user_id", "kind", "weight", "trust", ["ts", "event_id"]))
    return beliefs.context(f, "user_id").select("user_id", F.round("uncertainty", 6).alias("uncertainty"), "prose")
