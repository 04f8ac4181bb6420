"""Atoms and taint of PHP, and taint across calls, against a walk with a queue."""

import random
from collections import deque

import pytest

from tessera.flow import atoms, systemic, taint


def flows(code, **more):
    return [(f["sink"], f["variable"], f["state"], f["source"], f["line"], f["constraints"]) for f in taint.fold(code, **more).flows.values()]


def test_sources_are_told_apart():
    code = "\n$get = $_GET['id'];\n$cookie = $_COOKIE['user'];\n$own = 'constant';\necho $get;\necho $cookie;\necho $own;\n"
    assert flows(code) == [("echo", "$get", "TAINTED", "$_GET", 5, []), ("echo", "$cookie", "TAINTED", "$_COOKIE", 6, [])]


def test_names_are_whole_words():
    assert taint.fold("$row = $_GET['id']; // x\n$other = 'arrow';\n").variables["$other"].state == "CONSTANT"
    assert taint.fold("$a = $_GET['x'];\n$b = $a . 'y';\n$c = htmlspecialchars($a);\n$d = $c;\n$e = 5;\n$f = foo();\n").variables["$b"].state == "TAINTED"


def test_conditions_are_sinks_and_constraints():
    found = flows("$id = $_GET['id'];\nif ($id == 'admin') {\n    echo 'welcome';\n}\n")
    assert found == [("if ($id == 'admin')", "$id", "TAINTED", "$_GET", 2, ["$id == 'admin'"])]
    code = "<?php\nif( array_key_exists( \"name\", $_GET ) && $_GET[ 'name' ] != NULL ) {\n\t$name = htmlspecialchars( $_GET[ 'name' ] );\n\t$html .= \"<pre>Hello {$name}</pre>\";\n}\necho $html;\n"
    state = taint.fold(code)
    assert state.variables["$name"].state == "SAFE" and any(f["sink"] == "echo" for f in state.flows.values())


def test_properties_constants_and_calls():
    state = taint.fold("$u->name = $_POST['n'];\n$x = $u->name;\n$u->age = 3;\nif ($mode) { $t = 'a.php'; } else { $t = 'b.php'; }\nrequire $t;\ninclude ROOT . '/x.php';\n", constants={"ROOT": "www"})
    assert state.variables["$u"].state == "TAINTED" and state.variables["$x"].state == "TAINTED" and state.variables["$u"].properties["age"]["type"] == "number"
    assert [c["resolved"] for c in state.calls] == ["a.php", "b.php", "www/x.php"] and state.calls[1]["constraints"] == ["else branch"]
    assert flows("define('A', 'b');\necho A;\n") == []
    code = "class Box extends Base { public $size = 3; private static $name; function open($x) { echo $x; } }"
    box = taint.fold(code).variables["Box"]
    assert (box.state, box.methods, box.properties["size"]["default"], box.properties["name"]["visibility"]) == ("DEFINITION", ["open"], "3", "private")


def test_blanked_text_keeps_places():
    for code in ("a 'x\\'y' b // c\n\"q\" # z\n/* m\n n */ 'open", "'\\", '"a\\\\" . $b', "/* never closed", "''"):
        blank = atoms.blanked(code)
        assert len(blank) == len(code) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(blank) if c == "\n"]
    assert atoms.blanked("$a = 'b;c'; # d") == "$a = '   ';    "


def test_splitting():
    assert taint.split_arguments("$key, f($a, 'x,y'), [1, 2]") == ["$key", "f($a, 'x,y')", "[1, 2]"] and taint.split_arguments("") == []
    assert taint.parameters("($key, array $r = [1, 2], int $z)") == ["$key", "$r", "$z"] and taint.parameters("(a: int, b=2)") == ["int", "b"] and taint.parameters(None) == []


def test_too_many_combinations():
    code = "".join(f"if ($m{i}) {{ $v{i} = 'a'; }} else {{ $v{i} = 'b'; }}\n" for i in range(14)) + f"include {' . '.join(f'$v{i}' for i in range(14))};\n"
    with pytest.raises(ValueError, match="combinations"):
        taint.fold(code)


def test_rows_without_flows(spark):
    d = spark.createDataFrame([(1, "a.php", "$a = $_GET['x'];\necho $a;", "php"), (2, None, None, "php"), (3, "b.py", "echo $a;", "python"), (1, "a.php", "", "php")], "symbol long, file string, code string, language string")
    found = taint.analysed(d)
    assert found.count() == 4 and [(r["symbol"], r["sink"], r["position"]) for r in taint.flow_paths(found).collect()] == [(1, "echo", 0)]
    assert atoms.atoms(d).where("type = 'sink'").count() == 1 and taint.analysed(d.limit(0)).count() == 0


def by_queue(info, calls, start):
    out, visited, queue = [], set(), deque([(start, set(), [start])])
    while queue:
        now, came, path = queue.popleft()
        if now in visited:
            continue
        visited.add(now)
        if now not in info:
            continue
        own, found, _ = info[now]
        tainted = came | own
        out += [(start, " -> ".join(path), f["variable"], f["sink"], f["state"]) for f in found if f["variable"] in tainted and any(w in f["sink"] for w in systemic.DANGEROUS)]
        for callee in calls.get(now, []):
            params, passed = info[callee][2] if callee in info else [], set()
            for f in found:
                if f["sink"] and (f["sink"] in callee or callee in f["sink"]) and f["variable"] in tainted:
                    at = f["position"]
                    passed.add(f["variable"] if not params else params[min(at, len(params) - 1)] if at >= 0 else params[0])
            if callee not in visited:
                queue.append((callee, passed, [*path, callee]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_systemic_is_the_queue_walk(spark, seed):
    r = random.Random(seed)
    names = [f"f{i}" for i in range(9)]
    rows = []
    for n in names[:-1]:
        lines = [f"$x{i} = {r.choice(['$_GET[1]', '$p', '1', '$q'])};" for i in range(2)] + [f"{r.choice(names)}({', '.join(r.sample(['$x0', '$x1', '$p', '$q', '3'], 3))});" for _ in range(3)] + [f"echo {r.choice(['$p', '$q', '$x0'])};"]
        rows.append((n, "a.php", "\n".join(lines), "php", r.choice(["($p)", "($q, $p)", "()"])))
    found = taint.analysed(spark.createDataFrame(rows, "symbol string, file string, code string, language string, signature string"), signature="signature")
    info = {x["symbol"]: ({v["variable"] for v in x["variables"] if v["state"] == "TAINTED"}, [f.asDict() for f in x["flows"]], x["params"]) for x in found.collect()}
    edges = [(r.choice(names), r.choice(names), i) for i in range(25)]
    calls = {}
    for a, b, _ in edges:
        calls.setdefault(a, []).append(b)
    starts = spark.createDataFrame([(n,) for n in [*names[:4], "f0", "nowhere", None]], "start string")
    got = systemic.trace(found, spark.createDataFrame([*edges, (None, "f1", 1)], "src string, dst string, ordinal int"), starts).collect()
    for n in names[:4]:
        mine = sorted((x for x in got if x["start"] == n), key=lambda x: x["step"])
        assert [(x["start"], x["path"], x["variable"], x["sink"], x["state"]) for x in mine] == by_queue(info, calls, n)
