import io
import zipfile

from pyspark.sql import functions as F

from codeweave.functions import rules, scalars
from codeweave.operators import repos, review, sinks, text, vectors
from codeweave.sources import code, documents

PY = '''import os
from pkg.auth import login

LIMIT = 3

class User(Base):
    """A user."""
    def save(self, x: int) -> bool:
        if x and os.path.exists("a"):
            return self.check(x)
        return login(x)

    def check(self, x):
        return x

def test_user():
    User().save(1)
'''


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_python_symbols_and_relations(spark):
    files = spark.createDataFrame([("a/m.py", PY), ("bad.py", "def ("), ("x.unknown", "y"), ("n.py", None)], "path string, content string")
    got = {r.id: r for r in code.symbols(files).collect()}
    assert {(r.name, r.kind) for r in got.values()} == {("LIMIT", "Constant"), ("User", "Class"), ("save", "Method"), ("check", "Method"), ("test_user", "Test")}
    save = got["a/m.py::User::save"]
    assert (save.start_line, save.end_line, save.complexity, save.return_type, save.parent) == (8, 11, 3, "bool", "a/m.py::User") and got["a/m.py::User"].docstring == "A user."
    found = {(r.source_id, r.target_id, r.kind, r.receiver) for r in code.relations(files).collect()}
    assert {("a/m.py::User", "a/m.py::Base", "Inherits", ""), ("a/m.py::User::save", "a/m.py::check", "Calls", "User"), ("a/m.py", "a/m.py::pkg.auth", "Imports", "")} <= found


def test_sql_lineage_and_line_packs(spark):
    sql = "WITH c AS (SELECT * FROM raw.x)\nINSERT INTO mart.y SELECT * FROM c JOIN dim d ON 1=1; -- from z\nCREATE OR REPLACE VIEW v AS SELECT 1 FROM mart.y"
    files = spark.createDataFrame([("s.sql", sql), ("a.go", "package a\nfunc Run(x int) {\n}\ntype T struct {\n}"), ("b.ts", "export class A {\n}\nexport const f = (x) => x")], "path string, content string")
    assert rows(code.symbols(files), "name", "kind", "start_line", "end_line") == sorted([("mart.y", "Class", 2, 2), ("v", "Class", 3, 3), ("Run", "Function", 2, 3), ("T", "Struct", 4, 5), ("A", "Class", 1, 2), ("f", "Function", 3, 3)], key=str)
    assert {("s.sql::mart.y", "s.sql::dim"), ("s.sql::v", "s.sql::mart.y")} <= set(rows(code.relations(files), "source_id", "target_id"))


def test_manifests(spark):
    files = [("package.json", '{"dependencies": {"a": "^1.2"}, "devDependencies": {"b": "2"}}'), ("Cargo.toml", '[dependencies]\nx = "1"\ny = {version = "2"}'), ("requirements.txt", "flask==2.0 # web\n-r other\nnumpy"), ("go.mod", "require (\n\tgithub.com/a/b v1.2.3\n)"), ("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency>"), ("bad/package.json", "{"), ("Gemfile", "gem 'rails', '~> 7'"), ("p/a.csproj", '<PackageReference Include="N" Version="3" />'), ("pyproject.toml", '[project]\ndependencies = ["httpx[http2] >=0.2"]')]
    got = rows(code.dependencies(spark.createDataFrame(files, "path string, content string")), "id", "version", "is_dev")
    assert got == sorted([("npm::a", "^1.2", False), ("npm::b", "2", True), ("cargo::x", "1", False), ("cargo::y", "2", False), ("pypi::flask", "==2.0", False), ("pypi::numpy", "", False), ("go::github.com/a/b", "v1.2.3", False), ("maven::g:a", "1", True), ("rubygems::rails", "~> 7", False), ("nuget::N", "3", False), ("pypi::httpx", ">=0.2", False)], key=str)


def test_documents(spark):
    def zipped(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in files.items():
                z.writestr(name.replace("__", "/").replace("_x", ".x"), content)
        return out.getvalue()

    raw = [("a.docx", zipped(word__document_xml="<w:p><w:t>one &amp; two</w:t></w:p><w:p><w:t>three</w:t></w:p>")), ("b.pptx", zipped(ppt__slides__slide10_xml="<a:t>ten</a:t>", ppt__slides__slide2_xml="<a:t>two</a:t>")), ("c.rtf", rb"{\rtf1{\fonttbl{\f0 A;}}caf\'e9\par end}"), ("d.html", b"<p>x</p> <b>y</b>"), ("e.docx", b"junk"), ("f.bin", b"x"), ("g.md", "é".encode())]
    got = dict(rows(documents.texts(spark.createDataFrame(raw, "path string, content binary"))))
    assert got == {"a.docx": "one & two\nthree", "b.pptx": "two\n\nten", "c.rtf": "café\nend", "d.html": "x y", "g.md": "é"}


def test_chunks(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    c = documents.chunk_text(f"intro\n# One\n{words(5)}\nTwo\n---\n{words(600)}")
    assert [(h, len(t.split())) for h, t, *_ in c] == [("", 1), ("One", 7), ("Two", 512), ("Two", 154)]
    c = documents.chunk_text(f"Short title\n\n{words(300)}\n\n{words(300)}\n\n{words(520)}\n\ntail.")
    assert [len(t.split()) for _, t, *_ in c] == [302, 300, 512, 72, 1] and c[0][0] == "Short title"
    assert [len(t.split()) for _, t, *_ in documents.chunk_text(words(960))] == [512, 512] and documents.chunk_text(" \n") == []
    docs = spark.createDataFrame([("d/a.md", "# x\ny [b](../d/b.md#k) [e](https://e.x) <a href='#f'> [w](/wiki/q) [self](a.md)"), ("d/b.md", "t"), ("n", None)], "path string, text string")
    assert documents.chunks(docs).count() == 2
    assert rows(documents.link_edges(docs), "src", "dst") == [("d/a.md", "d/b.md")]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    g = lambda p, pattern: one(scalars.matches_glob(F.lit(p), pattern))
    assert g("src/a/B.py", "src/**/*.PY") and not g("src/a/b.py", "src/*.py") and g("ab.c", "a?.c")
    s = lambda v: one(scalars.vulnerability_severity(F.lit(v)))
    assert [s(v) for v in ("9.8", "7", "1", "CVSS:3/AV:N/C:H/I:H/A:H", "CVSS:3/C:H", "junk")] == ["CRITICAL", "HIGH", "LOW", "HIGH", "MEDIUM", "UNKNOWN"]
    assert one(scalars.http_verb(F.lit("deleteUser"))) == "DELETE" and one(scalars.http_verb(F.lit("x"))) is None
    assert one(scalars.name_to_path(F.lit("getUserOrders"))) == "/get/user/orders" and one(scalars.path_in_text(F.lit('at "/a/b" or /c'))) == "/a/b"
    assert one(scalars.xml_escape(F.lit("a<&'"))) == "a&lt;&amp;&apos;" and one(scalars.clean_version(F.lit("^1.2"))) == "1.2"
    assert one(scalars.rich_text(F.lit("Function"), F.lit("f"), F.lit("(x)"), F.lit("int"), F.lit("src/lib/a/b/c/d/e.py"), F.lit("py"), F.lit("doc"))) == "Function f(x) -> int in b/c/d/e.py [py]: doc"


def test_security_rules(spark):
    lines = [("a.py", "py", "x = pickle.loads(y)\npassword = \"abc\"\npassword = \"example\"\nyaml.load(f, Loader=yaml.SafeLoader)"), ("b.js", "js", "el.innerHTML = v; eval(x)"), ("c.md", "md", "eval(x)")]
    docs = spark.createDataFrame(lines, "path string, extension string, content string")
    assert len(rules.SECURITY) == 44
    assert rows(text.rule_scan(docs, rules.security_rules(spark).drop("category")), "path", "line", "rule_id", "col") == [("a.py", 1, "SEC030", 5), ("a.py", 2, "SEC010", 1), ("b.js", 1, "SEC021", 19), ("b.js", 1, "SEC100", 4)]


def test_repositories(spark):
    nodes = lambda *r: spark.createDataFrame(r, "id string, name string")
    edge = lambda *r: spark.createDataFrame(r, "src string, dst string")
    n, e = repos.combined({"a": nodes(("1", "x")), "b": nodes(("1", "y"))}, {"a": edge(("1", "1")), "b": edge(("1", "1"))})
    assert rows(n, "id", "repo") == [("[a]::1", "a"), ("[b]::1", "b")] and rows(e, "src") == [("[a]::1",), ("[b]::1",)]
    routes = spark.createDataFrame([("r1", "GET /api/users/:id", "Route", "f", "users"), ("r0", "MAPGET /api/users/:id", "Route", "f", "users")], "id string, name string, kind string, file string, repo string")
    offered = repos.contracts(routes)
    assert rows(offered) == [("users", "GET", "/api/users/:id", "r0", "f")]
    calls = spark.createDataFrame([("orders", "c1", "http://users/api/users/{id}"), ("users", "c2", "/api/users/{x}/")], "caller string, src string, url string")
    assert rows(repos.service_calls(calls, offered), "src", "symbol_id") == [("c1", "r0")]
    types = spark.createDataFrame([("A1", "Base", "a"), ("B1", "Base", "b"), ("A2", "Kid", "a")], "id string, name string, repo string")
    assert rows(repos.shared_parents(types, edge(("A2", "A1")))) == [("A2", "B1")]


def test_review_and_sinks(spark):
    symbols = spark.createDataFrame([(f"s{i}", f"n{i}", "Function", "a.py" if i < 45 else "b.py", i, i + (90 if i == 3 else 1), 40 if i == 3 else 16 if i == 4 else 1) for i in range(50)], "id string, name string, kind string, file string, start_line int, end_line int, complexity int")
    every = review.size_recommendations(symbols).unionByName(review.complexity_recommendations(symbols)).unionByName(review.dead_code_recommendations(symbols.where("file = 'b.py' or id = 's1'")))
    assert rows(review.prioritised(every, 9), "kind", "target", "priority") == sorted([("split_file", "a.py", 4), ("extract_function", "s3", 3), ("simplify_logic", "s4", 4), ("remove_dead_code", "b.py: n45, n46, n47, n48, n49", 3), ("remove_dead_code", "s1", 3)], key=str)
    edges = spark.createDataFrame([("s9", "s5"), ("s8", "s9")], "src string, dst string")
    hunk = spark.createDataFrame([("a.py", 5, 5)], "file string, start_line int, end_line int")
    assert ("s5", "direct") in rows(review.impact_of_hunks(symbols, edges, hunk)) and ("s8", "indirect") in rows(review.impact_of_hunks(symbols, edges, hunk))
    two = symbols.limit(1).select("id", F.lit("it's <b>").alias("name"))
    assert rows(sinks.cypher_script(two, edges.limit(1), "Symbol", "CALLS"))[0] == ("CREATE (:Symbol {id: 's0', name: 'it\\'s <b>'});",)
    xml = "".join(v for _, v in sorted(rows(sinks.graphml_rows(two, edges))))
    import xml.etree.ElementTree as tree

    assert len(list(tree.fromstring(xml).iter())) == 1 + 1 + 1 + 2 + 2
    texts = spark.createDataFrame([("1", "f", "abc"), ("2", "g", "d"), ("3", "g", "e")], "id string, file string, text string")
    stored = spark.createDataFrame([("1", [0.0]), ("2", [5.0]), ("9", [1.0])], "id string, embedding array<float>")
    got = dict(rows(sinks.refreshed_embeddings(stored, texts, texts.where("file = 'f'").select("file"), vectors.trigram_embedding(8))))
    assert set(got) == {"1", "2", "3"} and got["2"] == [5.0] and len(got["1"]) == 8
    s = spark.createDataFrame([(1, "2024-01-01 01:00", "a", "x", ["f"]), (1, "2024-01-01 02:00", "b", "", ["g", "f"]), (1, "2024-01-01 03:00", "c", "y", [])], "user_id int, ts string, summary string, decision string, files array<string>").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(sinks.merged_sessions(s), "summary", "decisions", "files") == [("c", "x | y", ["f", "g"])]


def test_line_packs_give_symbols_and_relations():
    from codeweave.sources.code import PACKS

    java = 'import java.util.List;\n\n/** Adds\n * numbers. */\n@Fast\npublic class Sum extends Base implements Run, Stop {\n    // one\n    public int add(int a) {\n        if (a > 0 && a < 9) { return helper(a) + this.other(a); }\n        return util.twice(a);\n    }\n}\n'
    symbols, relations = PACKS["java"]("S.java", java)
    assert [(s[1], s[2], s[4], s[9]) for s in symbols] == [("Sum", "Class", 6, 0), ("add", "Method", 8, 3)]
    assert symbols[0][8] == "Adds\nnumbers.\n@Fast" and symbols[1][8] == "one"
    assert {(r[1].split("::")[1], r[2], r[4], r[5]) for r in relations} == {("java.util.List", "IMPORTS", 1, ""), ("Base", "INHERITS", 6, ""), ("Run", "INHERITS", 6, ""), ("Stop", "INHERITS", 6, ""), ("helper", "CALLS", 9, ""), ("other", "CALLS", 9, "this"), ("twice", "CALLS", 10, "util")}
    one = {"swift": "final class A {\n  func f() {}\n}", "ex": "defmodule A.B do\n  def f(x), do: g(x)\nend", "hs": "module M where\nf :: Int -> Int", "lua": "local function f(x)\n return g(x)\nend", "sh": "f() {\n  echo x\n}", "vb": "Public Class A\n  Private Sub F()\n", "sol": "contract A is B {\n function f() public {}\n}", "proto": "service S {\n  rpc Get(A) returns (B);\n}", "tf": 'resource "aws_x" "web" {\n}', "clj": "(ns a.b)\n(defn f [x] x)", "f90": "module m\n subroutine f(x)\nend subroutine f", "jl": "struct P\nend\nfunction f!(x)\nend"}
    want = {"swift": ["A", "f"], "ex": ["A.B", "f"], "hs": ["M", "f"], "lua": ["f"], "sh": ["f"], "vb": ["A", "F"], "sol": ["A", "f"], "proto": ["S", "Get"], "tf": ["web"], "clj": ["a.b", "f"], "f90": ["m", "f"], "jl": ["P", "f!"]}
    assert {e: [s[1] for s in PACKS[e](f"x.{e}", t)[0]] for e, t in one.items()} == want
    assert [r[1] for r in PACKS["sol"]("x.sol", one["sol"])[1] if r[2] == "INHERITS"] == ["x.sol::B"]
    assert len(PACKS) >= 90
