import os
import random
import re
import struct
import subprocess

import pytest
from pyspark.sql import functions as F

from codeweave.functions import bridges, routes
from codeweave.operators import changes, graph, registry, symbols
from codeweave.plans.graph import PropertyGraph
from codeweave.sources import history, scip, walk
from codeweave.streaming import events, files


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_walk(spark, tmp_path):
    for name in ("a.py", "b.log", "keep.log", "src/c.py", "src/gen/d.py", "build/e.py", "src/build/f.py", ".hidden/g.py", "node_modules/h.js", "docs/i.md", "docs/tmp/j.md", "k.PY"):
        write(tmp_path, name, name)
    write(tmp_path, ".gitignore", "# logs\n*.log\n!keep.log\n/build\n")
    write(tmp_path, "src/.gitignore", "gen/\n")
    write(tmp_path, "docs/.codeweaveignore", "**/j.*\n")
    got = walk.walked(spark, str(tmp_path))
    assert [r[0] for r in rows(got, "path")] == ["a.py", "docs/i.md", "k.PY", "keep.log", "src/build/f.py", "src/c.py"]
    assert rows(walk.documents_of(got), "path") == [("docs/i.md",), ("keep.log",)] and ("k.PY", "py") in rows(got, "path", "extension")


@pytest.mark.parametrize("rule, yes, no", [("*.o", "x/y.o", "x/y.oo"), ("/a", "a/b", "x/a"), ("a/b", "a/b/c", "x/a/b"), ("a/", "x/a/b", "x/a"), ("a/**/b", "a/x/y/b", "a/xb"), ("?.c", "x/a.c", "x/ab.c"), ("**/t", "x/y/t", "tt")])
def test_ignore_rules(rule, yes, no):
    ((pattern, _),) = walk.ignore_rules(rule)
    assert re.search(pattern, yes) and not re.search(pattern, no)


def test_vectors_sessions_and_lines(spark, tmp_path):
    raw = struct.pack("<I", 2) + b"".join(struct.pack("<I", len(i)) + i + struct.pack("<I2f", 2, *v) for i, v in ((b"a::x", (1, 0.5)), ("é".encode(), (0, -2))))
    (tmp_path / "v.bin").write_bytes(raw)
    assert rows(walk.binary_vectors(spark, str(tmp_path / "v.bin"))) == [("a::x", [1.0, 0.5]), ("é", [0.0, -2.0])]
    write(tmp_path, "s/1.json", '{"id": "1", "summary": "x", "updated_at": 5}')
    write(tmp_path, "s/2.json", '{"id": "2", "files": ["a"], "updated_at": 9, "odd": 1}')
    assert [r.id for r in walk.recent_sessions(spark, str(tmp_path / "s")).collect()] == ["2", "1"]
    walk.append_log(spark.range(2), str(tmp_path / "log"))
    walk.append_log(spark.range(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3
    assert spark.range(1).select(walk.line_of_offset(F.lit("a\nb\nc"), F.lit(3))).first()[0] == 2


def test_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    write(tmp_path, "a.py", "def f():\n    return 1\n\n\ndef g():\n    return 2\n")
    git("add", "."), git("commit", "-qm", "first")
    write(tmp_path, "a.py", "def f():\n    return 1\n\n\ndef g():\n    return 3\n")
    git("mv", "a.py", "b.py"), git("commit", "-qam", "second | odd")
    log = history.commits(spark, history.output(str(tmp_path), "log", history.LOG))
    assert [r.subject for r in log.orderBy("subject").collect()] == ["first", "second | odd"]
    assert rows(history.statuses(spark, "A\tx.py\nR100\ta.py\tb.py\nD\tz"), "status", "file", "old_file") == [("A", "x.py", None), ("D", "z", None), ("R", "b.py", "a.py")]
    hunks = changes.hunks(history.diff_texts(spark, str(tmp_path), log))
    spans = spark.createDataFrame([("b.py::f", "b.py", 1, 2), ("b.py::g", "b.py", 5, 6)], "id string, file string, start_line int, end_line int")
    assert rows(symbols.commit_symbols(log, hunks, spans, author="n"), "id") == [("b.py::g",)]


def _message(number, payload):
    return bytes([number << 3 | 2, len(payload)]) + payload


def test_index_import(spark, tmp_path):
    occurrence = lambda line, symbol, roles: _message(2, _message(1, bytes([line, 0, 5])) + _message(2, symbol.encode()) + (bytes([3 << 3, roles]) if roles else b""))
    document = lambda path, *parts: _message(2, _message(1, path.encode()) + b"".join(parts) + _message(4, b"py"))
    raw = document("a.py", occurrence(0, "pkg f.", 1), occurrence(2, "pkg g.", 0), occurrence(1, "local 3", 0)) + document("b.py", occurrence(4, "pkg g.", 1), occurrence(5, "pkg g.", 0), occurrence(9, "pkg f.", 0))
    (tmp_path / "index.scip").write_bytes(_message(1, b"\x08\x01") + raw)
    found = scip.occurrences(spark, str(tmp_path / "index.scip"))
    assert rows(found, "file", "line", "symbol", "is_definition") == [("a.py", 1, "pkg f.", True), ("a.py", 3, "pkg g.", False), ("b.py", 10, "pkg f.", False), ("b.py", 5, "pkg g.", True), ("b.py", 6, "pkg g.", False)]
    spans = spark.createDataFrame([("a::f", "a.py", 1, 4), ("b::g", "b.py", 5, 7), ("b::C", "b.py", 5, 20)], "id string, file string, start_line int, end_line int")
    assert rows(scip.calls(found, spans)) == [("a::f", "b::g"), ("b::C", "a::f")]


def test_routes(spark):
    cases = [
        ("a.py::get_user_posts", "get_user_posts", "a.py", None, ("GET", "/user/posts", "generic_python")),
        ("a.py::UserView::post", "post", "a.py", "", ("POST", "/user", "django")),
        ("a.py::user_handler", "user_handler", "a.py", "x", ("UNKNOWN", "/user", "generic_python")),
        ("a.py::f", "f", "a.py", 'Flask route "/Items/{id}" DELETE it', ("DELETE", "/items/{id}", "flask")),
        ("c.ts::createOrder", "createOrder", "api/c.ts", "", ("POST", "/order", "generic_js")),
        ("c.ts::createOrder", "createOrder", "lib/c.ts", "", None),
        ("g.go::HandleUserList", "HandleUserList", "g.go", "gin. x", ("UNKNOWN", "/user/list", "gin")),
        ("j.java::C::deleteItem", "deleteItem", "J.java", "", ("DELETE", "/item", "spring")),
        ("p.py::plain", "plain", "p.py", "", None),
    ]
    table = spark.createDataFrame([(i, n, "Function", f, d) for i, n, f, d, _ in cases], "id string, name string, kind string, file string, docstring string")
    got = {(r.handler_id, r.file): (r.method, r.path, r.framework) for r in routes.routes(table).collect()}
    assert got == {(i, f): w for i, _, f, _, w in cases if w}
    files_ = spark.createDataFrame([("pages/api/users/[id].ts",), ("app/api/x/route.ts",), ("lib/Main.go",)], "f string")
    assert [r[0] for r in files_.select(routes.path_of_file(F.col("f"))).collect()] == ["/api/users/:id", "/api/x", "/main"]
    method, path = routes.contract(F.col("d"), F.col("n"))
    told = spark.createDataFrame([('@router.put("/a/{b}")', "x"), ("", "MapGet /c/d"), ("@GetMapping('/e')", "f")], "d string, n string")
    assert [tuple(r) for r in told.select(method, path).collect()] == [("PUT", "/a/{b}"), ("GET", "/c/d"), ("GET", "/e")]


def test_bridges(spark):
    cases = [("rs", 'pub extern "C" fn go_on();', "FFI", "go_on"), ("rs", "#[no_mangle]", "FFI", "exported_symbol"), ("java", "private native int sum(int a);", "JNI", "a"), ("java", 'System.loadLibrary("core");', "JNI", "core"), ("go", "  y := C.do_it(3)", "CGO", "C.do_it"), ("py", "lib = ctypes.CDLL('x.so', 1)", "CTYPES", "'x.so'"), ("proto", " service Users {", "GRPC", "Users"), ("bas", 'Declare Function F Lib "k32.dll" (x)', "FFI", "k32.dll"), ("bas", 'Set x = CreateObject("Excel.App")', "COM", "Excel.App"), ("py", "plain", None, None)]
    docs = spark.createDataFrame([(f"f{k}", e, f"first\n{line}") for k, (e, line, _, _) in enumerate(cases)], "path string, extension string, content string")
    got = {r.path: (r.line, r.kind, r.foreign_symbol) for r in bridges.bridge_scan(docs).collect()}
    assert got == {f"f{k}": (2, kind, s) for k, (_, _, kind, s) in enumerate(cases) if kind} and len(bridges.BRIDGES) == 26


def test_registry(spark, tmp_path):
    path = str(tmp_path / "r.json")
    r = registry.Registry.load(path)
    r.register("a", "/a"), r.register("b", "/b"), r.create_group("g"), r.add("g", "a"), r.add("g", "b"), r.add("g", "b")
    r.save(path)
    again = registry.Registry.load(path)
    assert again == r and rows(again.tables(spark)[1]) == [("g", "a"), ("g", "b")]
    for bad in (lambda: r.create_group("g"), lambda: r.add("g", "z"), lambda: r.add("h", "a"), lambda: r.remove("g", "z")):
        with pytest.raises(ValueError):
            bad()
    index = lambda name, p: PropertyGraph({"Symbol": spark.createDataFrame([(f"{name}1", p)], "id string, name string")}, {"CALLS": spark.createDataFrame([(f"{name}1", f"{name}1")], "src string, dst string")})
    g = registry.group_graph(again, "g", index)
    assert rows(g.cypher("MATCH (x:Symbol)-[:CALLS]->(y) WHERE x.repo = 'b' RETURN x.id, y.id")) == [("[b]::b1", "[b]::b1")]
    write(tmp_path, "c.toml", "[gates]\nmax_dead = 5\nother = 1\n")
    assert registry.gate_config(str(tmp_path / "c.toml")) == {"max_dead": 5}


def test_file_stream(spark, tmp_path):
    source, store, told, refreshed = tmp_path / "src", str(tmp_path / "graph"), [], []
    write(source, "a.py", "def f():\n    return g()\n")
    write(source, ".git/x.py", "def hidden():\n    pass\n")
    apply = files.indexer(store, lambda df, n: told.append(rows(df)), 1, lambda g, n: refreshed.append(n))
    run = lambda: events.ingest(files.file_changes(spark, str(source)), str(tmp_path / "check"), apply).awaitTermination()
    run()
    names = lambda: {r.name for r in PropertyGraph.load(spark, store).nodes["Symbol"].collect()}
    assert names() == {"f"}
    write(source, "b.py", "def g():\n    return 1\n")
    run()
    assert names() == {"f", "g"} and len(refreshed) == 2 and len(told) == 2
    g = PropertyGraph.load(spark, store)
    files_now = spark.createDataFrame([(r.file,) for r in g.nodes["Symbol"].where("name = 'g'").collect()], "path string")
    assert rows(files.removed(g, files_now)) == [(r.file,) for r in g.nodes["Symbol"].where("name = 'f'").collect()]
    docs = files.document_indexer(str(tmp_path / "chunks"))
    docs(spark.createDataFrame([("x.md", "# A\n\none two"), ("y.md", "three")], "path string, content string"), 0)
    docs(spark.createDataFrame([("y.md", "four five")], "path string, content string"), 1)
    assert {(r.doc_file, r.text.split()[-1]) for r in PropertyGraph.load(spark, str(tmp_path / "chunks")).nodes["Chunk"].collect()} == {("x.md", "two"), ("y.md", "five")}
    assert events.running(spark) == []


def test_affected_files(spark):
    nodes = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, file string")
    g = PropertyGraph({"Symbol": nodes}, {"CALLS": spark.createDataFrame([("a", "b"), ("c", "a")], "src string, dst string")})
    assert rows(files.affected(g, spark.createDataFrame([("1",)], "file string"))) == [("2",), ("3",)]


def test_louvain_is_as_good_as_a_sequential_sweep(spark):
    """Modularity against moving one node after another, on rings of cliques and a noisy graph of planted groups."""
    import random

    rng = random.Random(2)
    edges = [(c * 6 + i, c * 6 + j) for c in range(8) for i in range(6) for j in range(i)] + [(c * 6, (c + 1) % 8 * 6 + 1) for c in range(8)]
    edges += [(100 + a, 100 + b) for a in range(60) for b in range(a) if rng.random() < (0.5 if a % 4 == b % 4 else 0.03)]
    e = spark.createDataFrame(edges, "src long, dst long")
    ids = sorted({x for p in edges for x in p})
    place = graph.louvain(e, spark.createDataFrame([(i,) for i in ids], "id long"))
    got = graph.modularity(e, place).first()[0]
    near = {i: {} for i in ids}
    for a, b in edges:
        near[a][b] = near[a].get(b, 0) + 1
        near[b][a] = near[b].get(a, 0) + 1
    k, m2 = {i: sum(n.values()) for i, n in near.items()}, 2 * len(edges)
    own = {i: i for i in ids}
    for _ in range(20):
        for i in ids:
            tot, into = {}, {}
            for j in ids:
                if j != i:
                    tot[own[j]] = tot.get(own[j], 0) + k[j]
            for j, w in near[i].items():
                into[own[j]] = into.get(own[j], 0) + w
            best = max([own[i], *into], key=lambda c: (into.get(c, 0) - tot.get(c, 0) * k[i] / m2, -c))
            own[i] = best
    groups = {}
    for i, c in own.items():
        groups.setdefault(c, []).append(i)
    want = sum(sum(near[i].get(j, 0) for i in g for j in g) / m2 - (sum(k[i] for i in g) / m2) ** 2 for g in groups.values())
    assert got >= want - 0.02 and os.cpu_count()


@pytest.mark.parametrize("ids_a_row", [1 << 16, 3])
def test_commits_meet_lists_of_symbols_and_give_each_once(spark, ids_a_row):
    rng = random.Random(ids_a_row)
    some = lambda *c: rng.choice(c)
    commits = [(c, some("x", "xy", "z", None)) for c in range(12)] + [(3, "x"), (None, "x")]
    hunks = [(some(*range(12), None), some("f", "g", "h", None), lo := some(1, 2, 7, None), None if lo is None else lo + some(0, 3)) for _ in range(60)]
    spans = [(some("f", "g", "h", None), some(*range(9), None), lo := rng.randint(1, 9), lo + rng.randint(0, 2)) for _ in range(30)]
    want = {(c, a, i) for c, a in commits for d, f, low, high in hunks for g, i, start, end in spans if a and "x" in a and c is not None and c == d and f and f == g and low and start <= high and end >= low}
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = symbols.commit_symbols(df(commits, "commit long, author string"), df(hunks, "commit long, file string, start_line int, end_line int"), df(spans, "file string, id long, start_line int, end_line int"), author="x", ids_a_row=ids_a_row)
    assert rows(got, "commit", "author", "id") == sorted(want, key=str)
    if ids_a_row > 3:
        assert "array_distinct" in got._jdf.queryExecution().optimizedPlan().toString()
