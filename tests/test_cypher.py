import itertools
import random

import pytest
from pyspark.sql import functions as F

from codeweave.plans.cypher import CypherError
from codeweave.plans.graph import PropertyGraph


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([(i, f"s{i}", i % 2, f"f{i % 3}") for i in range(1, 8)], "id long, name string, x int, file string")
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25), (3, 1, 1.0), (3, 4, 1.0), (4, 5, 0.0), (6, 6, 0.1)], "src long, dst long, score double")
    owns = spark.createDataFrame([("a", 1), ("a", 2), ("b", 4)], "src string, dst long")
    files = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    return PropertyGraph({"Symbol": nodes}, {"CALLS": edges, "READS": edges.where("src = 1").select("src", "dst")}), PropertyGraph({"Symbol": nodes.withColumn("id", F.col("id").cast("string")), "File": files}, {"OWNS": owns.withColumn("dst", F.col("dst").cast("string")), "CALLS": edges})


def test_conditions(g):
    q = lambda t, **p: rows(g[0].cypher(t, **p))
    ids = lambda t, **p: [r[0] for r in q(f"MATCH (a:Symbol) WHERE {t} RETURN a.id", **p)]
    assert ids("a.id = 3 OR a.id = 1 AND EXISTS { MATCH (a)-[:CALLS]->(b) WHERE b.name = 's2' }") == [1, 3]
    assert ids("EXISTS { MATCH (a)-[:READS]->() } OR a.id = 7") == [1, 7]
    assert ids("NOT (EXISTS { MATCH (a)-[:CALLS]->() } OR a.id = 7)") == [5]
    assert ids("(a.id = 1 OR a.id = 2) AND NOT EXISTS { MATCH (a)-[:READS]->() }") == [2]
    assert ids("a.id + 1 * 2 = 5 OR (a.id - 1) * 2 = 12") == [3, 7]
    assert ids("a.id IN [-1, 2] OR a.id = -3") == [2] and ids("a.id IN $some", some=[4, 9]) == [4] and ids("a.name = $n", n="s5") == [5]
    assert ids("EXISTS { MATCH (p:Symbol {name: 'nobody'}) }") == [] and len(ids("EXISTS { MATCH (p:Symbol {name: 's1'}) }")) == 7


def test_patterns(g):
    q = lambda t: rows(g[0].cypher(t))
    assert q("MATCH (a:Symbol)-[:CALLS]-(b:Symbol) WHERE a.id = 3 RETURN b.id") == [(1,), (2,), (4,)]
    assert q("MATCH (a:Symbol)-[r:CALLS]->() RETURN a.id, count(r) AS n, max(r.score) AS s") == [(1, 1, 0.5), (2, 1, 0.25), (3, 2, 1.0), (4, 1, 0.0), (6, 1, 0.1)]
    assert q("MATCH (a:Symbol) OPTIONAL MATCH (a)-[r:CALLS {score: 1.0}]->() WITH a, count(r) AS n WHERE n > 0 RETURN a.name, n") == [("s3", 2)]
    assert q("MATCH (a)-[:CALLS]->(a) RETURN a.id") == [(6,)] and q("MATCH (a)-[:CALLS]->(b)-[:CALLS]->(c)-[:CALLS]->(a) WHERE a.name = 's1' RETURN b.name, c.id") == [("s2", 3)]
    assert q("MATCH (a:Symbol)-[:CALLS*0..1]->(b) WHERE a.id = 4 RETURN b.id") == [(4,), (5,)] and q("MATCH (a:Symbol)-[:CALLS*0..]->(b:Symbol) WHERE b.id = 2 RETURN a.id") == [(1,), (2,), (3,)]
    assert q("MATCH (a:Symbol)-[:CALLS*2]->(b) WHERE a.id = 2 RETURN b.id") == [(1,), (4,)] and q("MATCH (a:Symbol)<-[:CALLS*]-(b) WHERE a.id = 5 RETURN b.id") == [(1,), (2,), (3,), (4,)]
    assert q("UNWIND [{id: 1, w: 'x'}, {id: 9}] AS row MATCH (a:Symbol) WHERE a.id = row.id RETURN a.name, row.w") == [("s1", "x")]
    assert q("MATCH (a:Symbol) WITH a AS b ORDER BY b.id DESC LIMIT 2 RETURN b.name") == [("s6",), ("s7",)]
    assert rows(g[1].cypher("MATCH (f)-[:OWNS]->(s) WHERE f.name = 'A' RETURN s.file")) == [("f1",), ("f2",)]
    for bad in ("MATCH (a:Symbol) RETURN b.id", "MATCH (a)-[:CALLS]->(b) RETURN a.nothing", "MATCH (a:Symbol) WHERE a.id = $x RETURN a.id"):
        with pytest.raises(CypherError):
            g[0].cypher(bad)


@pytest.mark.parametrize("low, high", [(0, 2), (1, None), (2, None), (3, 3), (2, 4)])
def test_walks_equal_brute_force(spark, low, high):
    rng = random.Random(low * 7 + (high or 0))
    edges = list({(rng.randint(0, 7), rng.randint(0, 7)) for _ in range(9)})
    g = PropertyGraph({"N": spark.range(8)}, {"E": spark.createDataFrame(edges, "src long, dst long")})
    now, want = {(i, i) for i in range(8)}, set()
    for n in range(40):
        if n >= low and (high is None or n <= high):
            want |= now
        now = {(a, d) for a, b in now for c, d in edges if b == c}
    text = f"MATCH (a:N)-[:E*{low}..{'' if high is None else high}]->(b:N)"
    assert rows(g.cypher(f"{text} RETURN a.id, b.id")) == sorted(want)
    assert rows(g.cypher(f"{text} WHERE b.id = 3 RETURN a.id")) == sorted((a,) for a, b in want if b == 3)
    assert rows(g.cypher(f"{text} WHERE a.id = 3 AND b.id > 1 RETURN b.id")) == sorted((b,) for a, b in want if a == 3 and b > 1)


def test_a_long_path_is_walked_to_its_end(spark):
    g = PropertyGraph({"N": spark.range(70)}, {"E": spark.range(69).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))})
    assert g.cypher("MATCH (a:N {id: 0})-[:E*]->(b) RETURN count(b) AS n").first().n == 69


def test_seeds_reach_the_first_frontier(g):
    from codeweave.plans import cypher

    seen = []
    whole = cypher.walks
    try:
        cypher.walks = lambda edges, low, high, seeds=None, back=False: seen.append((rows(seeds), back)) or whole(edges, low, high, seeds, back)
        assert rows(g[0].cypher("MATCH (a:Symbol)-[:CALLS*1..3]->(b) WHERE a.name = 's1' RETURN b.id")) == [(1,), (2,), (3,), (4,)]
        assert rows(g[0].cypher("MATCH (a:Symbol)<-[:CALLS*1..2]-(b:Symbol {id: 2}) RETURN a.id")) == [(1,), (3,), (4,)]
    finally:
        cypher.walks = whole
    assert seen == [([(1,)], False), ([(2,)], False)]


def test_create_and_merge(g, spark):
    h = g[0].execute("CREATE (n:Symbol {id: 20, name: 'new', extra: 'e'}); CREATE (a:Tag {id: 't'})-[:MARKS {w: 2}]->(b:Tag {id: 'u'}); MATCH (a:Symbol), (b:Symbol) WHERE a.id = 20 AND b.id = 1 CREATE (a)-[:CALLS {score: 9.0}]->(b)")
    assert (20, "new", "e") in rows(h.nodes["Symbol"], "id", "name", "extra") and rows(h.edges["MARKS"]) == [("t", "u", 2)] and rows(h.nodes["Tag"]) == [("t",), ("u",)]
    assert (20, 1, 9.0) in rows(h.edges["CALLS"]) and len(rows(g[0].edges["CALLS"])) == 6
    h = g[0].execute("UNWIND $new AS p MERGE (n:Symbol {id: p.id}) ON CREATE SET n.name = p.name, n.x = 0 ON MATCH SET n.x = n.x + 10", new=[{"id": 1, "name": "no"}, {"id": 30, "name": "yes"}, {"id": 30, "name": "zes"}])
    got = {r.id: r for r in h.nodes["Symbol"].collect()}
    assert (got[1].name, got[1].x) == ("s1", 11) and (got[30].name, got[30].x, got[30].file) == ("yes", 0, None) and len(got) == 8 and got[2].x == 0
    h = g[0].execute("MATCH (a:Symbol)-[:CALLS]->(b:Symbol) MERGE (a)-[r:SIMILAR]->(b) SET r.score = 0.5; MATCH (a:Symbol {id: 1}), (b:Symbol {id: 2}) MERGE (a)-[r:SIMILAR]->(b) SET r.score = 0.75")
    assert len(rows(h.edges["SIMILAR"])) == 6 and (1, 2, 0.75) in rows(h.edges["SIMILAR"]) and (4, 5, 0.5) in rows(h.edges["SIMILAR"])


def test_set_and_delete(g):
    h = g[0].execute("MATCH (a:Symbol)-[r:CALLS]->(b) WHERE a.id = 3 SET a.name = 'three', a.seen = true, r.score = 7")
    assert {r.id: (r.name, r.seen) for r in h.nodes["Symbol"].collect() if r.id < 4} == {1: ("s1", None), 2: ("s2", None), 3: ("three", True)}
    assert [r for r in rows(h.edges["CALLS"]) if r[2] == 7] == [(3, 1, 7.0), (3, 4, 7.0)]
    h = g[0].execute("BEGIN TRANSACTION; MATCH (a:Symbol)-[r:CALLS]->(b) WHERE r.score = 1.0 DELETE r; MATCH (n:Symbol) WHERE n.id > 5 DETACH DELETE n; COMMIT;")
    assert rows(h.edges["CALLS"], "src", "dst") == [(1, 2), (2, 3), (4, 5)] and len(rows(h.nodes["Symbol"])) == 5 and len(rows(h.edges["READS"])) == 1
    with pytest.raises(CypherError):
        g[0].execute("MATCH (n:Symbol) WHERE n.id = 1 DELETE n")
    assert len(rows(g[0].execute("MATCH (n:Symbol) WHERE n.id = 7 DELETE n").nodes["Symbol"])) == 6


def test_tables_and_copies(spark, tmp_path):
    g = PropertyGraph().execute(
        "CREATE NODE TABLE IF NOT EXISTS Symbol(id STRING, name STRING, line INT32, PRIMARY KEY(id)); CREATE REL TABLE CALLS(FROM Symbol TO Symbol, score DOUBLE);"
        "CREATE NODE TABLE IF NOT EXISTS Symbol(id STRING PRIMARY KEY); ALTER TABLE Symbol ADD language STRING DEFAULT 'py'; ALTER TABLE Symbol ADD IF NOT EXISTS language STRING"
    )
    assert g.schema() == {"Symbol": ["id", "name", "line", "language"], "CALLS": ["src", "dst", "score"]}
    spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "id string, name string, line long").write.parquet(str(tmp_path / "s.parquet"))
    (tmp_path / "c.csv").write_text("src|dst|score\na|b|0.5\n")
    g = g.execute(f"COPY Symbol(id, name, line) FROM '{tmp_path}/s.parquet'; COPY CALLS FROM '{tmp_path}/c.csv' (HEADER=true, DELIM='|')")
    assert rows(g.nodes["Symbol"]) == [("a", "A", 1, None), ("b", "B", 2, None)] and rows(g.edges["CALLS"]) == [("a", "b", 0.5)]
    g.execute(f"COPY (MATCH (a:Symbol)-[:CALLS]->(b:Symbol) RETURN a.name AS x, b.line AS y) TO '{tmp_path}/out.parquet'")
    assert rows(spark.read.parquet(str(tmp_path / "out.parquet"))) == [("A", 2)]
    assert g.execute("DROP TABLE CALLS; DROP TABLE IF EXISTS Nothing").edges == {}
    for bad in ("DROP TABLE Nope", "CREATE NODE TABLE Symbol(id STRING)", "CREATE (n {id: 1})", "MATCH (a:Symbol) MERGE (a)-[:X]->(b)"):
        with pytest.raises(CypherError):
            g.execute(bad)


def test_versions(g, spark, tmp_path):
    folder = str(tmp_path / "graph")
    with pytest.raises(FileNotFoundError):
        PropertyGraph.load(spark, folder)
    g[0].save(folder)
    old = PropertyGraph.load(spark, folder)
    g[0].execute("MATCH (n:Symbol) WHERE n.id > 3 DETACH DELETE n").save(folder)
    assert len(rows(PropertyGraph.load(spark, folder).nodes["Symbol"])) == 3 and len(rows(old.nodes["Symbol"])) == 7
    # A version whose list isn't finished doesn't count.
    (tmp_path / "graph" / "_version-0000000009").mkdir()
    assert len(rows(PropertyGraph.load(spark, folder).nodes["Symbol"])) == 3
    assert len(list(itertools.chain(tmp_path.glob("graph/_version-*")))) == 3


@pytest.mark.parametrize("low, high", [(0, 2), (1, None), (2, 4)])
def test_values_at_the_ends_of_walks_are_those_of_all_pairs(spark, low, high):
    rng = random.Random(low * 11 + (high or 0))
    edges = spark.createDataFrame(list({(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(12)}), "src long, dst long")
    nodes = spark.createDataFrame([(i, None if i % 4 == 3 else f"n{i % 4}", i % 3) for i in range(9)], "id long, name string, x int")
    g = PropertyGraph({"N": nodes, "Some": nodes.where("x > 0")}, {"E": edges})
    for pattern in (f"(a:Some)-[:E*{low}..{'' if high is None else high}]->(b:N)", f"(a:Some)<-[:E*{low}..{'' if high is None else high}]-(b:N)"):
        every = {r[:2] for r in rows(g.cypher(f"MATCH {pattern} WHERE b.x < 2 AND a.x <= b.x RETURN a.id AS a, b.name AS n, b.id AS b"))}
        assert rows(g.cypher(f"MATCH {pattern} WHERE b.x < 2 AND a.x <= b.x RETURN DISTINCT a.id AS a, b.name AS n")) == sorted(every, key=str)


def test_walks_start_at_a_label_and_keep_no_pairs_for_distinct_values(spark, monkeypatch):
    from codeweave.plans import cypher

    stored = []

    def counting(df, name="table", **more):
        out = materialize(df, name, **more)
        stored.append((name, out.count()))
        return out

    materialize = cypher.materialize
    monkeypatch.setattr(cypher, "materialize", counting)
    n = spark.range(60).withColumn("name", (F.col("id") % 2).cast("string"))
    e = n.select(F.col("id").alias("src")).crossJoin(n.select(F.col("id").alias("dst")))
    g = PropertyGraph({"N": n, "Seed": n.where("id < 3")}, {"E": e})
    assert g.cypher("MATCH (a:Seed)-[:E*1..3]->(b:N) RETURN DISTINCT a.id AS a, b.name AS name").count() == 6
    assert all(rows <= 3 for name, rows in stored if name == "walks")
    stored.clear()
    assert g.cypher("MATCH (a:Seed)-[:E*1..2]->(b:N) RETURN a.id AS a, b.id AS b").count() == 180
    assert all(rows <= 180 for name, rows in stored if name == "walks")
