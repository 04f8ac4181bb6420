"""A record that breaks each rule and one that doesn't; likewise for the scans."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import lint, text
from tessera.operators import scans

GOOD = {"code": "", "name": "get_x", "signature": "", "docstring": "Gets", "path": "src/a.py", "kind": "Function", "language": "python"}
CASES = {
    "LR-01": ({"signature": "(a, b, c, d, e)"}, {"signature": "(a, f(b, c), [d, e], {g: h}, 'i, j')"}),
    "LR-02": ({"path": "src/components/button.tsx"}, {"path": "src/components/Button.tsx"}),
    "LR-03": ({"path": "src/hooks/state.ts"}, {"path": "src/hooks/useState.ts"}),
    "LR-04": ({"path": "api/v1/userDelete.ts"}, {"path": "api/v1/users.ts"}),
    "LR-05": ({"code": "db.SELECT ( '*' )"}, {"code": "select a"}),
    "LR-06": ({"code": "go(request)", "signature": "(request)"}, {"code": "schema.check(request)", "signature": "(request)"}),
    "LR-07": ({"code": "x as any"}, {"code": "x: anyone"}),
    "LR-08": ({"code": "setCount(count + 1)"}, {"code": "setCount(c => c + 1)"}),
    "LR-09": ({"code": "try { a() } catch { }"}, {"code": "try { a() } catch (e) { log(e) }"}),
    "LR-10": ({"code": "response.json(body)", "path": "src/api/x.ts"}, {"code": "response.json({success: 1})", "path": "src/api/x.ts"}),
    "LR-11": ({"code": "subprocess.run (x)"}, {"code": "evaluate(x)"}),
    "LR-12": ({"code": "f = os.system"}, {"code": "f = os.path"}),
    "LR-13": ({"code": "auth_key: 'abc'"}, {"code": "max_token = 'abc'"}),
    "LR-14": ({"code": "DEBUG = True"}, {"code": "DEBUG = False"}),
    "LR-15": ({"code": "db.EXECUTE('select ' \n + 'x')"}, {"code": "db.execute(sql)"}),
    "LR-16": ({"code": "requests.get(u)"}, {"code": "requests.get(u, timeout=t)"}),
    "LR-17": ({"code": "while True:\n  go()"}, {"code": "while True:\n  break"}),
    "LR-18": ({"code": "except ValueError: pass"}, {"code": "except ValueError: passed()"}),
    "LR-19": ({"code": "yaml.load(f)"}, {"code": "yaml.load(f, SafeLoader)"}),
    "LR-20": ({"code": 'open(f"{x}")'}, {"code": "open(path)"}),
    "LR-21": ({"code": "os.chmod(p, 0o777)"}, {"code": "path.chmod(0o777)"}),
    "LR-22": ({"code": "async def f():\n  shutil.copy()"}, {"code": "def f():\n  shutil.copy()"}),
    "LR-23": ({"code": "for x in y:\n  z.append(x)"}, {"code": "for x in y:\n  z.append(x)\nlen(z)"}),
    "LR-24": ({"code": "global xs"}, {"code": "# global xs"}),
    "LR-25": ({"code": "@lru_cache\ndef f(): go()"}, {"code": "@lru_cache(maxsize=n)\ndef f(): go()"}),
    "LR-26": ({"name": "dataGet"}, {"name": "fetchData"}),
    "LR-27": ({"code": "a()\n" * 51}, {"code": "a()\n" * 50}),
    "LR-28": ({"code": "a()\n" + " " * 16 + "b()"}, {"code": " " * 15 + "b()"}),
    "LR-29": ({"code": "if ready: x = y"}, {"code": "if x == y: go()"}),
    "LR-30": ({"code": "xs.push(y)"}, {"code": "xs.concat(y)"}),
    "LR-31": ({"code": "fetch(u)"}, {"code": "try { fetch(u) } finally {}"}),
    "LR-32": ({"code": "aa = 1\nbb = 37"}, {"code": "aa = 100\nbb = '37'"}),
    "LR-33": ({"code": "a ? b : c ? d : e"}, {"code": "a ? b : c\nd ? e : f"}),
    "LR-34": ({"code": "# increment it\n\nnn += step"}, {"code": "# explain it\nnn += step"}),
    "LR-35": ({"code": "await one()\n\nawait two()"}, {"code": "await one()\ngo()\nawait two()"}),
    "LR-36": ({"signature": "(is_open: bool)"}, {"signature": "(open: bool)"}),
    "LR-37": ({"docstring": " \n\t"}, {"docstring": "x"}),
    "LR-38": ({"signature": "(a)", "docstring": "Gets a"}, {"signature": "(a)", "docstring": "Gets\n\nArgs:\n    a (int): one"}),
}


def test_a_pair_for_each_rule(spark):
    names = list(GOOD)
    rows = [(rule, bad, *({**GOOD, **part}[n] for n in names)) for rule, pair in CASES.items() for bad, part in zip((True, False), pair, strict=True)]
    d = spark.createDataFrame([*rows, ("null", False, None, "get", *[None] * 4, "python")], ["rule", "bad", *names])
    got = d.select("rule", "bad", lint.broken(**{n: F.col(n) for n in names}).alias("broken")).collect()
    assert {r["rule"]: r["broken"] for r in got if r["rule"] == "null"}["null"] == ["LR-37"]
    assert [r["rule"] for r in got if r["rule"] != "null" and (r["rule"] in r["broken"]) != r["bad"]] == []


def test_texts_of_warnings(spark):
    code = "async def f():\n    time.sleep(t)\n    subprocess.call(x)\n" + "    " * 4 + "deep = 37"
    d = spark.createDataFrame([tuple({**GOOD, "code": code}.values())], list(GOOD))
    said = d.select(lint.warnings(**{n: F.col(n) for n in GOOD}).alias("w")).first()["w"]
    assert "Magic number detected: 37" in said and "Deep nesting detected (> 3 levels) around line 4" in said
    assert [w for w in said if w.startswith("Async")] == [
        "Async safety: blocking call 'time.sleep' detected in async function. Use await asyncio.sleep() instead.",
        "Async safety: blocking call 'subprocess.' detected in async function. Use asyncio.create_subprocess_exec() instead.",
    ]
    found = scans.parser_warnings(d.select("name", F.lit("f").alias("file"), F.explode(F.array(*map(F.lit, said))).alias("warning"))).collect()
    assert sorted((r["cwe"], r["severity"]) for r in found) == [("CWE-400", "LOW"), ("CWE-400", "LOW"), ("CWE-94", "CRITICAL")]


SCANS = {
    scans.hardcoded_credentials: ("private_key = 'abc'", "max_token = 'abc'"), scans.sensitive_in_logs: ("print(api_key)", "print(mask(api_key))"), scans.endless_loop: ("while  True: go()", "while True: break"),
    scans.no_timeout: ("requests.get(u)", "requests.get(u, timeout=1)"), scans.cleartext_storage: ("json.dump(token, share)", "json.dump(sha(token), f)"),
}


def test_a_pair_for_each_scan(spark):
    for scan, (bad, good) in SCANS.items():
        d = spark.createDataFrame([("bad", "f", bad), ("good", "f", good), ("null", None, None)], "name string, file string, code string")
        assert [r["function"] for r in scans.of_code(d, (scan,)).collect()] == ["bad"], scan
    schema = "name string, file string, code string, docstring string, score double, mass double, exported boolean, seq int"
    of = lambda *rows: spark.createDataFrame(rows, schema)
    rules = spark.createDataFrame([("guarded", "authorization", "Only the owner"), ("log_token", "event", "Logs it"), ("send_token", "io", "masks it"), ("checked", "authorization", "the caller")], "source_function string, category string, description string")
    reach = of(("delete_user", "auth.py", None, None, 0.85, 5.0, True, 1), ("guarded", "auth.py", "", "", 0.9, 5.0, True, 2), ("calibrate_it", "a.py", "", "", 0.9, 9.0, True, 3), ("quiet", "a.py", "x", "x", 0.9, 1.0, False, 4), ("small", "a.py", "@router.x", "", 0.1, 1.0, False, 5), ("routed", "tests/a.py", "@router.x", "", 0.9, 1.0, False, 6), ("app", "a.py", "app.get(x)", "", 0.9, 1.0, False, 7))
    assert [(r["function"], r["severity"]) for r in scans.missing_authorization(reach, rules).collect()] == [("delete_user", "CRITICAL")]
    own = of(("guarded", "b.py", "balance += amt", "", 0.0, 0.0, False, 2), ("guarded", "a.py", "if x: y", "", 0.0, 0.0, False, 3), ("checked", "a.py", "ASSERT x", "", 0.0, 0.0, False, 4))
    assert [(r["function"], r["file"]) for r in scans.incorrect_authorization(own, rules).collect()] == [("guarded", "b.py")]
    told = of(("log_token", "a.py", "", "", 0.0, 0.0, False, 1), ("send_token", "a.py", "", "", 0.0, 0.0, False, 2))
    assert [r["function"] for r in scans.exposed_by_rule(told, rules).collect()] == ["log_token"]


@pytest.mark.parametrize(("sink", "weakness"), [("mysqli_query($q)", 89), ("error_log(x)", 532), ("blueprint", None), ("print query", 79), ("fopen open", 22)])
def test_sink_weakness(spark, sink, weakness):
    assert spark.range(1).select(scans.sink_weakness(F.lit(sink)).alias("w")).first()["w"] == weakness


def test_rules_of_records(spark):
    rows = [("f", ["Only the owner may access", "nothing"], "", ""), ("g", [], "Must check and validate " + "x" * 300, ""), ("h", None, None, "@login_required_auth\nzod.parse(x)"), ("i", [], "  ", "is_admin (u)")]
    d = spark.createDataFrame(rows, "name string, stated array<string>, doc string, code string")
    got = d.select(F.inline(text.rules_of(F.col("name"), F.col("stated"), F.col("doc"), F.col("code")))).collect()
    assert [(r["source_function"], r["category"], len(r["description"])) for r in got if r["source_function"] in "fg"] == [("f", "authorization", 25), ("g", "validation", 200)]
    assert [r["confidence"] for r in got] == [1.0, 0.6, 0.85, 0.85, 0.85] and [r["category"] for r in got][2:] == ["authorization", "validation", "authorization"]


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    lit = F.lit
    assert one(text.safe_name(lit("a/b:c"))) == "a_b_c" and len(one(text.safe_name(lit("x" * 80)))) == 57
    assert one(text.masked(lit("API_KEY"), lit("v"))) == "********" and one(text.masked(lit("host"), lit("v"))) == "v"
    assert [one(text.literal_type(lit(v))) for v in ("'a'", "[1]", "array(1)", "new A", "TRUE", "1.5", "$x", "", "1.2.3")] == ["string", "array", "array", "object", "boolean", "number", "dynamic", "unknown", "dynamic"]
    assert one(text.inline_category(lit("Log the database query"))) == "event" and one(text.inline_category(lit("Plain"))) == "generic"
    assert one(text.table_cell(lit('a|b"c\n' + "x" * 90)))[:8] == "a\\|b'c x" and one(text.table_cell(lit(""))) == "—"
    assert one(text.is_documentation(lit("Docs/README.txt"), lit(None))) and not one(text.is_documentation(lit("a.py"), lit("run")))
    assert one(text.kind_of(F.array(lit("Function"), lit("Class")))) == "Class" and one(text.kind_of(F.array(lit("X")))) == "Function"
    assert one(text.qualified(lit("a.py"), lit("f"))) == "a.py:f" and one(text.qualified(lit("a.py"), lit("b:f"))) == "b:f"
    assert one(text.slug(lit("/a b/c/"))) == "a-b-c" and one(text.meaning(lit(" a\nb "))) == "a b"
    assert one(text.ignored(lit("docs/a.md"))) and not one(text.ignored(lit("a.py"))) and one(text.is_code(lit("a.tsx")))
    assert text.branch_name("feature/x-1") and text.within("/v", "a", "b") == "/v/a/b"
    for bad in ("", "-x", "a b"):
        with pytest.raises(ValueError):
            text.branch_name(bad)
    with pytest.raises(ValueError):
        text.within("/v", "../etc")
