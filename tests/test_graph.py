import pytest

from codeweave.operators import changes, graph, text
from codeweave.plans.cypher import CypherError
from codeweave.plans.graph import PropertyGraph
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([(i, f"s{i}", "Function" if i < 5 else "Class", f"f{i % 3}", i) for i in range(1, 7)], "id long, name string, kind string, file string, line int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (3, 4), (4, 5), (6, 4)], "src long, dst long")
    return PropertyGraph({"Symbol": nodes}, {"CALLS": edges})


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_hubs_count_parallel_edges(g):
    assert [tuple(r) for r in graph.hubs(g.edges["CALLS"], g.nodes["Symbol"], 2).collect()] == [(4, "s4", 3), (1, "s1", 1)]


def test_reach_returns_the_start_only_through_a_cycle(g, spark):
    one = spark.createDataFrame([(1,)], "id long")
    assert rows(graph.reach(g.edges["CALLS"], one, 2)) == [(2, 1), (3, 2)]
    assert rows(graph.reach(g.edges["CALLS"], one)) == [(1, 3), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert rows(graph.reach(g.edges["CALLS"], one.where("id > 9"))) == []


def test_dead_code_and_entry_points(g):
    assert rows(graph.dead_code(g.edges["CALLS"], g.nodes["Symbol"]), "id") == [(6,)]
    assert rows(graph.dead_code(g.edges["CALLS"], g.nodes["Symbol"], live_names=["s*"]), "id") == []
    assert rows(graph.entry_points(g.edges["CALLS"], g.nodes["Symbol"]), "id") == [(6,)]


def test_cypher(g):
    q = lambda t: rows(g.cypher(t))
    assert q("MATCH (a:Symbol)-[:CALLS]->(b:Symbol {name: 's4'}) RETURN a.id, count(*) AS n") == [(3, 2), (6, 1)]
    assert q("MATCH (a:Symbol)<-[:CALLS]-(b) WHERE NOT a.id IN [1, 2] RETURN DISTINCT a.id") == [(3,), (4,), (5,)]
    assert q("MATCH (a:Symbol)-[:CALLS*1..2]->(b:Symbol) WHERE a.id = 1 RETURN b.id ORDER BY b.id") == [(2,), (3,)]
    assert q("MATCH (a:Symbol)-[:CALLS*]->(b:Symbol) WHERE a.id = 6 RETURN b.id") == [(4,), (5,)]
    assert q("MATCH (a:Symbol) WHERE a.name STARTS WITH 's' AND NOT EXISTS { MATCH (a)-[:CALLS]->() } RETURN a.id") == [(5,)]
    assert q("MATCH (a:Symbol), (b:Symbol) WHERE a.file = b.file AND a.id < b.id RETURN a.id, b.id") == [(1, 4), (2, 5), (3, 6)]
    assert q("MATCH (a:Symbol) OPTIONAL MATCH (a)-[:CALLS]->(b) WITH a.id AS id, count(b) AS n WHERE n = 0 RETURN id, n") == [(5, 0)]
    assert q("UNWIND [1, 2] AS x RETURN x") == [(1,), (2,)]
    for bad in ("MATCH (a:Nope) RETURN a.id", "MATCH (a:Symbol)", "RETURN x", "MATCH (a:Symbol) RETURN a.id %"):
        with pytest.raises(CypherError):
            g.cypher(bad)


def test_save_load_and_remove(g, spark, tmp_path):
    g.save(str(tmp_path))
    again = PropertyGraph.load(spark, str(tmp_path))
    assert rows(again.edges["CALLS"]) == rows(g.edges["CALLS"])
    left = again.without(spark.createDataFrame([(3,)], "id long"))
    assert rows(left.edges["CALLS"]) == [(1, 2), (4, 5), (6, 4)]
    assert (7, None) in rows(g.merged("Symbol", spark.createDataFrame([(7, "new"), (1, "one")], "id long, name string")).nodes["Symbol"], "id", "kind")


def test_resolution_ranks(spark):
    c = spark.createDataFrame([("x.py::A::run", "run", "x.py", "Method", "A"), ("y.py::B::run", "run", "y.py", "Method", "B"), ("y.py::solo", "solo", "y.py", "Function", ""), ("z.py::run", "run", "z.py", "Function", "")], "id string, name string, file string, kind string, parent string")
    raw = spark.createDataFrame([(1, "run", "m.py", "B"), (2, "solo", "m.py", ""), (3, "run", "m.py", ""), (4, "run", "n.py", ""), (5, "solo", "y.py", "")], "call_id int, name string, file string, receiver string")
    imports = spark.createDataFrame([("n.py", "z.py")], "file string, target_file string")
    learned = spark.createDataFrame([("n.py", "solo", "x.py::A::run")], "file string, name string, target string")
    assert rows(graph.resolve(raw, c, imports, learned)) == [(1, "y.py::B::run", 1), (2, "y.py::solo", 2), (4, "z.py::run", 4)]


def test_louvain_finds_two_cliques(spark):
    pairs = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(0, 10)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(5), *range(10, 15), 99]], "id long")
    place = dict(rows(graph.louvain(edges, nodes)))
    assert {place[i] for i in range(5)} == {0} and {place[i] for i in range(10, 15)} == {10} and place[99] == 99
    assert graph.modularity(edges, spark.createDataFrame(list(place.items()), "id long, community long")).first()[0] > 0.4


def test_hunks_and_snippets(spark):
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +12 @@ f\n+++ b/y\n@@ -5,2 +7,0 @@\n-gone"
    assert rows(changes.hunks(spark.createDataFrame([("c", diff)], "commit string, text string"))) == [("c", "x", 3, 6), ("c", "x", 12, 12), ("c", "y", 7, 7)]
    doc = spark.createDataFrame([(1, "a\nb\nc")], "id int, content string")
    assert rows(text.snippet(doc, -3, 2)) == [(1, "a\nb")] and rows(text.snippet(doc, 3, 9)) == [(1, "c")]


def test_stream_matches_batch(spark, tmp_path):
    from codeweave.streaming import events as streams

    rows_in = spark.range(200).select(F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id"))).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    rows_in.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows_in.schema).parquet(str(tmp_path / "in"))
    q = streams.windowed(source, "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("w")) == rows(streams.windowed(spark.read.parquet(str(tmp_path / "in")), "1 hour"))
    seen = []
    files = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "path string, ts long, content string")
    files.write.parquet(str(tmp_path / "files"))
    q = streams.ingest(spark.readStream.schema(files.schema).parquet(str(tmp_path / "files")), str(tmp_path / "state"), lambda df, n: seen.extend(rows(df, "path", "content")))
    q.awaitTermination()
    assert sorted(seen) == [("a", "y"), ("b", "z")]


def test_louvain_shuffles_a_part_of_the_edges_once_a_round(spark, monkeypatch):
    plans, materialize = [], graph.materialize

    def watched(df, name="table", **more):
        if name == "place":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name, **more)

    monkeypatch.setattr(graph, "materialize", watched)
    e = spark.range(300).select((F.col("id") % 20).alias("src"), (F.col("id") * 7 % 23).alias("dst"))
    place = graph.louvain(e, spark.range(25).select("id"), sweeps=1)
    assert place.count() == 25 and place.where("id >= 23 and id <> community").count() == 0
    scans = [x for x in plans[-1].splitlines() if "FileScan" in x and "w#" in x]
    assert len(scans) == 1 and "Bucketed: true" in scans[0]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("codeweave_")]
