"""The queries of the code-graph operators on the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.functions.rules import SECURITY, security_rules
from codeweave.operators import changes, graph, repos, text, vectors
from codeweave.plans.graph import PropertyGraph
from codeweave.session import materialize
from codeweave.sources import adapters as A
from codeweave.sources.adapters import table, with_tables
from codeweave.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, tables: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_tables(tables, sql) if tables else sql
        return f

    return register


def code_graph(s: SparkSession, d: str) -> PropertyGraph:
    return PropertyGraph({"Symbol": A.symbols(s, d)}, {"CALLS": A.calls(s, d), "TESTED_BY": A.tested_by(s, d)})


# --- aggregates over the graph ------------------------------------------------------------------------------------------

@query("SELECT id, name, count(*) AS calls FROM calls JOIN symbols ON dst = id GROUP BY ALL ORDER BY calls DESC, id LIMIT 10", "calls symbols")
def hub_top10(s, d):
    return graph.hubs(A.calls(s, d), A.symbols(s, d))


@query("SELECT kind, count(*) AS symbols FROM symbols GROUP BY kind", "symbols")
def kind_breakdown(s, d):
    return A.symbols(s, d).groupBy("kind").agg(F.count("*").alias("symbols"))


@query("SELECT language, count(*) AS files FROM files GROUP BY language", "files")
def language_breakdown(s, d):
    return A.files(s, d).groupBy("language").agg(F.count("*").alias("files"))


@query("SELECT file, count(*) AS symbols FROM symbols GROUP BY file ORDER BY symbols DESC, file LIMIT 10", "symbols")
def hotspots(s, d):
    return graph.top_k(A.symbols(s, d).groupBy("file").agg(F.count("*").alias("symbols")), 10, F.desc("symbols"), "file")


@query("SELECT 'symbols' AS name, count(*) AS rows FROM symbols UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'tested_by', count(*) FROM tested_by UNION ALL SELECT 'inherits', count(*) FROM inherits", "symbols calls tested_by inherits")
def graph_stats(s, d):
    return PropertyGraph({"symbols": A.symbols(s, d)}, {"calls": A.calls(s, d), "tested_by": A.tested_by(s, d), "inherits": A.inherits(s, d)}).stats()


@query("SELECT DISTINCT id, name, file FROM people WHERE id IN (SELECT src FROM inherits) AND id NOT IN (SELECT dst FROM inherits)", "inherits people")
def entry_points(s, d):
    return graph.entry_points(A.inherits(s, d), A.people(s, d)).select("id", "name", "file").distinct()


@query("SELECT 'out' AS side, id, degree FROM (SELECT src AS id, count(DISTINCT dst) AS degree FROM calls GROUP BY src HAVING count(DISTINCT dst) >= 15 ORDER BY degree DESC, id LIMIT 20) UNION ALL SELECT 'in', id, degree FROM (SELECT dst AS id, count(DISTINCT src) AS degree FROM calls GROUP BY dst HAVING count(DISTINCT src) >= 20 ORDER BY degree DESC, id LIMIT 20)", "calls")
def fan_in_out(s, d):
    e = A.calls(s, d)
    side = lambda name, column, least: graph.degree(e, column, least).select(F.lit(name).alias("side"), "id", "degree")
    return side("out", "src", 15).unionAll(side("in", "dst", 20))


@query("SELECT id, name, complexity, CASE WHEN complexity > 30 THEN 'High' ELSE 'Medium' END AS impact, CASE WHEN complexity > 30 THEN 'High' ELSE 'Medium' END AS effort, CASE WHEN complexity > 30 THEN 3 ELSE 4 END AS priority FROM symbols WHERE complexity >= 15 ORDER BY complexity DESC, id LIMIT 10", "symbols")
def complexity_hotspots(s, d):
    high = F.col("complexity") > 30
    rows = A.symbols(s, d).where("complexity >= 15").orderBy(F.desc("complexity"), "id").limit(10)
    return rows.select("id", "name", "complexity", F.when(high, "High").otherwise("Medium").alias("impact"), F.when(high, "High").otherwise("Medium").alias("effort"), F.when(high, 3).otherwise(4).alias("priority"))


@query("SELECT file, count(*) AS symbols, count(t.src) AS covered, CAST(floor(100.0 * count(t.src) / count(*)) AS BIGINT) AS percent FROM symbols LEFT JOIN (SELECT DISTINCT src FROM tested_by) t ON t.src = id GROUP BY file", "symbols tested_by")
def coverage(s, d):
    tested = A.tested_by(s, d).select(F.col("src").alias("id")).distinct().withColumn("hit", F.lit(1))
    rows = A.symbols(s, d).join(tested, "id", "left").groupBy("file").agg(F.count("*").alias("symbols"), F.count("hit").alias("covered"))
    return rows.withColumn("percent", F.floor(F.lit(100.0) * F.col("covered") / F.col("symbols")).cast("long"))


# Every part is called in the dense graph of calls, so dead code is looked for among the nodes of INHERITS.
@query("SELECT id, name, file FROM people WHERE id NOT IN (SELECT dst FROM inherits) AND kind IN ('BUILDING', 'Supplier', 'Nation') AND name <> 'Supplier#1' AND name NOT LIKE 'Customer#1%'", "inherits people")
def dead_code(s, d):
    return graph.dead_code(A.inherits(s, d), A.people(s, d), ["BUILDING", "Supplier", "Nation"], ["Supplier#1", "Customer#1*"]).select("id", "name", "file")


@query("SELECT dst AS parent, count(DISTINCT src) AS implementations, CASE WHEN count(DISTINCT src) >= 5 THEN 'high' ELSE 'medium' END AS confidence FROM inherits GROUP BY dst HAVING count(DISTINCT src) >= 3", "inherits")
def strategy_pattern(s, d):
    return graph.implementations(A.inherits(s, d))


@query("SELECT c.src AS factory, count(DISTINCT c.dst) AS products FROM calls c JOIN symbols a ON a.id = c.src JOIN symbols b ON b.id = c.dst WHERE a.kind <> b.kind AND b.id IN (SELECT src FROM tested_by) GROUP BY c.src HAVING count(DISTINCT c.dst) >= 12", "calls symbols tested_by")
def factory_pattern(s, d):
    nodes = A.symbols(s, d).select("id", "kind")
    made = nodes.join(A.tested_by(s, d).select(F.col("src").alias("id")), "id", "left_semi")
    e = A.calls(s, d).distinct().join(nodes.select(F.col("id").alias("src"), F.col("kind").alias("ka")), "src").join(made.select(F.col("id").alias("dst"), F.col("kind").alias("kb")), "dst")
    return e.where("ka <> kb").groupBy(F.col("src").alias("factory")).agg(F.count_distinct("dst").alias("products")).where("products >= 12")


# --- joins and traversal ------------------------------------------------------------------------------------------------

@query("SELECT DISTINCT dst AS callee, id, name, file FROM calls JOIN symbols ON src = id", "calls symbols")
def callers(s, d):
    return graph.callers(A.calls(s, d), A.symbols(s, d))


@query("SELECT DISTINCT src AS caller, id, name, file FROM calls JOIN symbols ON dst = id", "calls symbols")
def callees(s, d):
    return graph.callees(A.calls(s, d), A.symbols(s, d))


_REACH = "walk(id, n) AS (SELECT {a}, 1 FROM calls WHERE {seed} UNION SELECT e.{a}, n + 1 FROM walk JOIN calls e ON e.{b} = walk.id WHERE n < {depth}) SELECT id, CAST(min(n) AS INTEGER) AS level FROM walk GROUP BY id"


@query(with_tables("calls", ", " + _REACH.format(a="src", b="dst", seed="dst IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')", depth=3)))
def impact_d3(s, d):
    return graph.reach(A.calls(s, d), A.symbols(s, d).where("file = 'Brand#2'"), 3, reverse=True)


@query(with_tables("calls", ", " + _REACH.format(a="dst", b="src", seed="src IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#3')", depth=12)))
def reachable(s, d):
    return graph.reach(A.calls(s, d), A.symbols(s, d).where("file = 'Brand#3'"))


@query(with_tables("inherits", ", up(id, other, n) AS (SELECT src, dst, 1 FROM inherits UNION ALL SELECT up.id, e.dst, n + 1 FROM up JOIN inherits e ON e.src = up.other) SELECT id, other, CAST(min(n) AS INTEGER) AS level FROM up GROUP BY ALL"))
def hierarchy_up(s, d):
    return graph.hierarchy(A.inherits(s, d), "up")


@query(with_tables("inherits", ", down(id, other, n) AS (SELECT dst, src, 1 FROM inherits UNION ALL SELECT down.id, e.src, n + 1 FROM down JOIN inherits e ON e.dst = down.other), least AS (SELECT id, other, min(n) AS n FROM down GROUP BY ALL) SELECT id, CAST(n AS INTEGER) AS level, count(*) AS descendants FROM least GROUP BY ALL"))
def hierarchy_down(s, d):
    return graph.hierarchy(A.inherits(s, d), "down").groupBy("id", "level").agg(F.count("*").alias("descendants"))


@query(with_tables("calls", ", walk(id, n) AS (SELECT src, 1 FROM calls WHERE dst IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#4') UNION SELECT e.src, n + 1 FROM walk JOIN calls e ON e.dst = walk.id WHERE n < 2) SELECT DISTINCT id FROM walk WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#4')"))
def blast_radius(s, d):
    return graph.reach(A.calls(s, d), A.symbols(s, d).where("file = 'Brand#4'"), 2, reverse=True).join(A.symbols(s, d).where("file = 'Brand#4'").select("id"), "id", "left_anti").select("id")


@query(with_tables("calls", ", node(id, n) AS (SELECT p_partkey, 0 FROM part WHERE p_brand = 'Brand#9' UNION SELECT e.dst, n + 1 FROM node JOIN calls e ON e.src = node.id WHERE n < 2), least AS (SELECT id, min(n) AS n FROM node GROUP BY id) SELECT DISTINCT CAST(n + 1 AS INTEGER) AS level, src, dst FROM least JOIN calls ON src = id"))
def bfs_edges(s, d):
    return graph.bfs_edges(A.calls(s, d), A.symbols(s, d).where("file = 'Brand#9'"), 3)


@query(with_tables("calls", ", two_way AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls), node(id, n) AS (SELECT p_partkey, 0 FROM part WHERE p_brand = 'Brand#12' UNION SELECT e.dst, n + 1 FROM node JOIN two_way e ON e.src = node.id WHERE n < 2) SELECT DISTINCT src, dst FROM calls WHERE src IN (SELECT id FROM node) AND dst IN (SELECT id FROM node)"))
def neighbourhood(s, d):
    return graph.subgraph(A.calls(s, d), A.symbols(s, d).where("file = 'Brand#12'"), 2)


@query("SELECT DISTINCT a.file, b.file AS other FROM (SELECT src, dst FROM calls UNION ALL SELECT dst, src FROM calls) e JOIN symbols a ON a.id = e.src JOIN symbols b ON b.id = e.dst WHERE a.file <> b.file", "calls symbols")
def cross_file_dependents(s, d):
    return graph.cross_file(A.calls(s, d), A.symbols(s, d))


@query("SELECT file, id, low, high FROM spans JOIN (SELECT s_suppkey AS file, 2 AS low, 3 AS high FROM supplier) USING (file) WHERE start_line <= high AND end_line >= low", "spans")
def interval_overlap(s, d):
    ranges = table(s, d, "supplier").select(F.col("s_suppkey").alias("file"), F.lit(2).alias("low"), F.lit(3).alias("high"))
    return graph.overlapping(A.spans(s, d), ranges).select("file", "id", "low", "high")


@query("SELECT file, line, arg_min(id, (end_line - start_line)::BIGINT * 1000000000 + id) AS id FROM spans JOIN (SELECT s_suppkey AS file, 2 AS line FROM supplier) USING (file) WHERE start_line <= line AND line <= end_line GROUP BY file, line", "spans")
def innermost_interval(s, d):
    return graph.innermost(A.spans(s, d), table(s, d, "supplier").select(F.col("s_suppkey").alias("file"), F.lit(2).alias("line")))


_RAW = "raw AS (SELECT id AS call_id, name, file, CASE WHEN id % 3 = 0 THEN kind ELSE '' END AS receiver FROM symbols), imports AS (SELECT DISTINCT a.file, b.file AS target_file FROM calls JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE (src + dst) % 4 = 0)"


@query(with_tables("calls symbols", f""", {_RAW}, pairs AS (
  SELECT r.call_id, c.id AS target, r.receiver, c.kind AS parent, r.file, c.file AS target_file, count(*) OVER (PARTITION BY r.call_id) AS n
  FROM raw r JOIN symbols c USING (name) WHERE r.file <> c.file),
ranked AS (SELECT call_id, target, CASE WHEN receiver <> '' AND parent = receiver THEN 1 WHEN n = 1 THEN 2
  WHEN EXISTS (SELECT 1 FROM imports i WHERE i.file = pairs.file AND i.target_file = pairs.target_file) THEN 4 END AS rank FROM pairs),
best AS (SELECT call_id, min(rank * 1000000000000 + target) AS b FROM ranked WHERE rank IS NOT NULL GROUP BY call_id)
SELECT call_id, b % 1000000000000 AS target, CAST(b // 1000000000000 AS INTEGER) AS rank FROM best"""))
def name_resolution_ranked(s, d):
    sym = A.symbols(s, d)
    raw = sym.select(F.col("id").alias("call_id"), "name", "file", F.when(F.col("id") % 3 == 0, F.col("kind")).otherwise("").alias("receiver"))
    ends = A.calls(s, d).where("(src + dst) % 4 = 0").join(sym.select(F.col("id").alias("src"), "file"), "src").join(sym.select(F.col("id").alias("dst"), F.col("file").alias("target_file")), "dst")
    return graph.resolve(raw, sym.withColumn("parent", F.col("kind")), ends.select("file", "target_file"))


@query("WITH t AS (SELECT doc_id AS id, text AS name, source AS repo FROM documents), k AS (SELECT repo, name, min(id) AS rep, count(*) AS members FROM t WHERE name IS NOT NULL GROUP BY ALL) SELECT a.rep AS src, b.rep AS dst, a.members, b.members AS others FROM k a JOIN k b ON a.name = b.name AND a.repo <> b.repo")
def cross_repo_pairs(s, d):
    return repos.same_types(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"), F.col("source").alias("repo")))


@query("SELECT a.page_id AS caller, min(b.page_id) AS target, regexp_replace(a.url, '^https?://[^/]*', '') AS path FROM pages a JOIN pages b ON regexp_replace(a.url, '^https?://[^/]*', '') = regexp_replace(b.url, '^https?://[^/]*', '') AND a.page_id <> b.page_id GROUP BY a.page_id, a.url")
def contracts_cross(s, d):
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    a = table(s, d, "pages").select(F.col("page_id").alias("caller"), path.alias("path"))
    b = table(s, d, "pages").select(F.col("page_id").alias("target"), path.alias("path"))
    return a.join(b, "path").where("caller <> target").groupBy("caller", "path").agg(F.min("target").alias("target"))


@query("SELECT id, name FROM people p WHERE kind = 'BUILDING' AND complexity >= 5 AND id NOT IN (SELECT dst FROM inherits) AND (complexity > 40 OR EXISTS (SELECT 1 FROM inherits JOIN people n ON n.id = dst WHERE src = p.id AND n.file IN ('1', '2')))", "people inherits")
def cypher_exists(s, d):
    g = PropertyGraph({"Symbol": A.people(s, d)}, {"INHERITS": A.inherits(s, d)})
    return g.cypher("MATCH (n:Symbol {kind: 'BUILDING'}) WHERE n.complexity >= 5 AND NOT EXISTS { MATCH ()-[:INHERITS]->(n) } AND (n.complexity > 40 OR EXISTS { MATCH (n)-[:INHERITS]->(p:Symbol) WHERE p.file IN ['1', '2'] }) RETURN n.id AS id, n.name AS name")


# Undirected edges, edge counts, zero hops and unbounded walks of the front end.
@query("WITH e AS (SELECT src AS a, dst AS b FROM inherits UNION ALL SELECT dst, src FROM inherits) SELECT a AS id, count(*) AS n FROM e JOIN people ON id = a WHERE kind <> 'Supplier' GROUP BY a".replace("WITH ", "WITH " + A.SQL["inherits"] + ", " + A.SQL["people"] + ", ", 1))
def cypher_undirected(s, d):
    g = PropertyGraph({"Symbol": A.people(s, d)}, {"INHERITS": A.inherits(s, d)})
    return g.cypher("MATCH (a:Symbol)-[r:INHERITS]-(b) WHERE a.kind <> 'Supplier' RETURN a.id AS id, count(r) AS n")


@query(with_tables("inherits people", ", up(id, other) AS (SELECT id, id FROM people UNION SELECT up.id, e.dst FROM up JOIN inherits e ON e.src = up.other) SELECT id, other FROM up JOIN people p USING (id) WHERE p.kind IN ('Supplier', 'Nation')"))
def cypher_unbounded(s, d):
    g = PropertyGraph({"Symbol": A.people(s, d)}, {"INHERITS": A.inherits(s, d)})
    return g.cypher("MATCH (a:Symbol)-[:INHERITS*0..]->(b:Symbol) WHERE a.kind IN ['Supplier', 'Nation'] RETURN a.id AS id, b.id AS other")


@query("SELECT id, name, CASE WHEN id IN ('n:1', 'n:2') THEN 'seen' END AS note FROM people WHERE kind <> 'BUILDING' UNION ALL SELECT 'x:1', 'new', 'made'", "people")
def cypher_writes(s, d):
    g = PropertyGraph({"Symbol": A.people(s, d)}, {"INHERITS": A.inherits(s, d)})
    h = g.execute("UNWIND [{id: 'n:1', name: 'a'}, {id: 'n:2'}, {id: 'x:1', name: 'new'}] AS p MERGE (n:Symbol {id: p.id}) ON CREATE SET n.name = p.name, n.note = 'made' ON MATCH SET n.note = 'seen'; MATCH (n:Symbol) WHERE n.kind = 'BUILDING' DETACH DELETE n")
    return h.nodes["Symbol"].select("id", "name", "note")


@query("SELECT b.name, count(*) AS calls, count(DISTINCT a.id) AS callers FROM calls JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE a.kind IN ('SMALL', 'PROMO') OR b.name LIKE '%e%' GROUP BY b.name ORDER BY calls DESC, b.name LIMIT 10", "calls symbols")
def cypher_hubs(s, d):
    return code_graph(s, d).cypher("MATCH (a:Symbol)-[:CALLS]->(b:Symbol) WHERE a.kind IN ['SMALL', 'PROMO'] OR b.name CONTAINS 'e' RETURN b.name AS name, count(*) AS calls, count(DISTINCT a.id) AS callers ORDER BY calls DESC, name LIMIT 10")


@query(with_tables("calls symbols", ", walk(a, b, n) AS (SELECT src, dst, 1 FROM calls WHERE src IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#17') UNION SELECT walk.a, e.dst, n + 1 FROM walk JOIN calls e ON e.src = walk.b WHERE n < 3) SELECT DISTINCT walk.a AS start, s.name FROM walk JOIN symbols s ON s.id = walk.b"))
def cypher_paths(s, d):
    sym = A.symbols(s, d)
    g = PropertyGraph({"Symbol": sym, "Seed": sym.where("file = 'Brand#17'")}, {"CALLS": A.calls(s, d)})
    return g.cypher("MATCH (a:Seed)-[:CALLS*1..3]->(b:Symbol) RETURN DISTINCT a.id AS start, b.name AS name")


@query("SELECT s.file, count(t.dst) AS tests, avg(CAST(s.complexity AS DOUBLE)) AS mean FROM symbols s LEFT JOIN (SELECT src, dst FROM tested_by) t ON t.src = s.id GROUP BY s.file HAVING count(t.dst) > 3", "symbols tested_by")
def cypher_optional(s, d):
    return code_graph(s, d).cypher("MATCH (s:Symbol) OPTIONAL MATCH (s)-[:TESTED_BY]->(t) WITH s.file AS file, count(t) AS tests, avg(s.complexity) AS mean WHERE tests > 3 RETURN file, tests, mean")


# --- retrieval ----------------------------------------------------------------------------------------------------------

WORDS = "the license of and und que"
_TOKENS = "list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: strlen(t) > 1)"
_BM25 = f"""tok AS (SELECT id, {_TOKENS.format(x='content')} AS t FROM files), q AS (SELECT unnest({_TOKENS.format(x="'" + WORDS + "'")}) AS term),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)::DOUBLE) AS avgdl FROM tok),
tf AS (SELECT id, term, len(list_filter(t, lambda x: x = term))::DOUBLE AS tf, len(t)::DOUBLE AS dl FROM tok, (SELECT DISTINCT term FROM q)),
df AS (SELECT term, sum(CASE WHEN tf > 0 THEN 1.0::DOUBLE ELSE 0 END) AS df FROM tf GROUP BY term),
bm AS (SELECT id, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY id)"""
_VEC = "vec AS (SELECT v.vec_id AS id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(with_tables("files", f", {_BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20"))
def bm25_top20(s, d):
    return text.bm25(A.files(s, d), WORDS, 20).select("id", F.round("score", 6).alias("score"))


def _query_vector(s, d):
    return table(s, d, "embeddings").where("vec_id = 0").first()["embedding"]


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("owner"), "embedding")


@query(f"WITH {_VEC} SELECT id, round(score, 6) AS score FROM vec ORDER BY vec.score DESC, id LIMIT 20")
def vector_top20(s, d):
    return vectors.nearest(_vectors(s, d), _query_vector(s, d), 20).select("id", F.round("score", 6).alias("score"))


@query(with_tables("files", f", {_BM25}, {_VEC}, a AS (SELECT * FROM bm ORDER BY score DESC, id LIMIT 40), b AS (SELECT * FROM vec ORDER BY score DESC, id LIMIT 40), h AS (SELECT coalesce(a.id, b.id) AS id, 0.5::DOUBLE * coalesce(a.score / greatest((SELECT max(score) FROM a), 0.001), 0) + 0.5::DOUBLE * coalesce(b.score / greatest((SELECT max(score) FROM b), 0.001), 0) AS score FROM a FULL JOIN b ON a.id = b.id) SELECT id, round(score, 6) AS score FROM h ORDER BY h.score DESC, id LIMIT 20"))
def hybrid_top20(s, d):
    both = vectors.hybrid(text.bm25(A.files(s, d), WORDS), vectors.nearest(_vectors(s, d), _query_vector(s, d)), 0.5, 20)
    return both.select("id", F.round("score", 6).alias("score"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35")
def clones_vec(s, d):
    return vectors.similar_pairs(_vectors(s, d), 0.35).select("a", "b", F.round("score", 6).alias("score"))


@query(None)
def lsh_neighbours(s, d):
    v = _vectors(s, d)
    return vectors.hashed_neighbours(v, v.where("id % 100 = 0"), 5)


@query(None)
def trigram_embed(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), vectors.trigram_embedding()("p_name").alias("embedding"))


@query(with_tables("files", f"SELECT id, len({_TOKENS.format(x='content')}) AS tokens FROM files"))
def token_counts(s, d):
    return A.files(s, d).select("id", F.size(text.tokens(F.col("content"))).cast("long").alias("tokens"))


# --- text and documents -------------------------------------------------------------------------------------------------

_LINES = "ln AS (SELECT id, path, unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files)"


@query(with_tables("files", f", {_LINES} SELECT path, CAST(line AS INTEGER) AS line, content FROM ln WHERE regexp_matches(content, '[Ll]icense')"))
def grep_lines(s, d):
    return text.grep(A.files(s, d), "[Ll]icense")


_RULE_ROWS = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (r, sev, f" {ext} " if ext else "", pat.lower(), ex.lower())) + ")" for r, _, sev, ext, pat, ex in SECURITY)


@query(with_tables("files", f""", {A.SQL["code"]}, {_LINES.replace("SELECT id, path,", "SELECT id, path, extension,").replace("FROM files", "FROM code")}, rules(rule_id, severity, extensions, pattern, exclude) AS (VALUES {_RULE_ROWS})
SELECT path, CAST(line AS BIGINT) AS line, rule_id, severity, strlen(string_split(lower(content), pattern)[1]) + 1 AS col, substr(trim(content), 1, 120) AS snippet FROM ln JOIN rules ON contains(lower(content), pattern)
WHERE (extensions = '' OR contains(extensions, ' ' || extension || ' ')) AND NOT (exclude <> '' AND contains(lower(content), exclude))"""))
def rule_scan(s, d):
    return text.rule_scan(A.code(s, d), security_rules(s))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def html_text(s, d):
    return table(s, d, "pages").select("page_id", text.html_text(F.col("html")).alias("text"), text.html_title(F.col("html")).alias("title"))


@query("SELECT page_id, url, CASE WHEN regexp_matches(url, '/wiki/|confluence|atlassian') THEN 'confluence' WHEN regexp_matches(url, '/browse/|jira') THEN 'jira' WHEN regexp_matches(url, '^(https?:)?//') THEN 'external' ELSE 'local' END AS link_type FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=[\"'']([^\"'']+)[\"'']', 1)) AS url FROM pages) WHERE NOT starts_with(url, '#')")
def page_links(s, d):
    return text.links(table(s, d, "pages").select("page_id", "html"))


@query("WITH p AS (SELECT page_id, regexp_replace(url, '/+$', '') AS u FROM pages) SELECT page_id, regexp_replace(CASE WHEN contains(u, '/api/') THEN '/api/' || regexp_replace(u, '^.*?/api/', '') WHEN regexp_matches(u, '^https?://') THEN regexp_replace(u, '^https?://[^/]*', '') ELSE u END, '/[:{<][^/]*', '/*', 'g') AS route FROM p")
def url_normalise(s, d):
    return table(s, d, "pages").select("page_id", text.normalised_route(F.col("url")).alias("route"))


@query("WITH p AS (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS p FROM pages), e AS (SELECT p, unnest(generate_series(1, len(p) - 1)) AS n FROM p WHERE len(p) > 1) SELECT array_to_string(p[1:n], '/') AS folder, array_to_string(p[1:n-1], '/') AS parent, count(*) AS files FROM e GROUP BY ALL")
def folder_tree(s, d):
    return text.folders(table(s, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")))


@query(with_tables("files", ", w AS (SELECT id, list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '') AS w FROM files), e AS (SELECT id, w, unnest(generate_series(0, CAST(ceil(greatest(0, len(w) - 512) / 448.0) AS BIGINT))) AS idx FROM w WHERE len(w) > 0) SELECT id, idx, len(w[idx * 448 + 1 : idx * 448 + 512]) AS words, array_to_string(w[idx * 448 + 1 : idx * 448 + 512], ' ') AS text FROM e"))
def chunk_fixed_512_64(s, d):
    return text.word_windows(A.files(s, d))


@query(with_tables("files", "SELECT id, array_to_string(string_split(content, chr(10))[2:3], chr(10)) AS snippet FROM files"))
def snippet_lines(s, d):
    return text.snippet(A.files(s, d), 2, 3)


@query("SELECT p_partkey AS id, lower(regexp_replace(replace(p_type, ' ', '') || 'NameOf', '([A-Z])', '_\\1', 'g')) AS snake FROM part")
def snake_names(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), text.snake_case(F.concat(F.lit("_"), F.regexp_replace("p_type", " ", ""), F.lit("NameOf"))).alias("s")).select("id", F.expr("substring(s, 2)").alias("snake"))


# --- changes ------------------------------------------------------------------------------------------------------------

@query(with_tables("snapshots", """, b AS (SELECT file, name, kind, o.hash AS before, n.hash AS after FROM old o FULL JOIN new n USING (file, name, kind)),
added AS (SELECT file, name, kind, (SELECT min(o.file) FROM old o WHERE o.name = b.name AND o.kind = b.kind AND o.file <> b.file) AS old_file FROM b WHERE before IS NULL)
SELECT file, name, kind, CASE WHEN old_file IS NULL THEN 'ADDED' ELSE 'MOVED' END AS change, old_file FROM added
UNION ALL SELECT file, name, kind, 'SIGNATURE_CHANGED', NULL FROM b WHERE before <> after
UNION ALL SELECT file, name, kind, 'REMOVED', NULL FROM b WHERE after IS NULL AND NOT EXISTS (SELECT 1 FROM added a WHERE a.old_file IS NOT NULL AND a.name = b.name AND a.kind = b.kind)"""))
def semantic_diff(s, d):
    return changes.semantic_diff(*A.snapshots(s, d))


@query("SELECT path, id FROM files WHERE language = 'es' OR contains(content, ' and ')", "files")
def hash_skip(s, d):
    now = A.files(s, d)
    stored = now.where("language <> 'es'").select("path", F.when(F.col("content").contains(" and "), F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return changes.changed_files(stored, now.select("path", "id", "content_hash")).select("path", "id")


_CLUSTER = """WITH g AS (SELECT *, lag(ts) OVER w AS newer FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)),
c AS (SELECT *, sum(CASE WHEN epoch_us(newer) - epoch_us(ts) > {gap} * 1000000::BIGINT THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS grp FROM g)
SELECT user_id, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM c WHERE grp = 0 GROUP BY user_id"""


@query(_CLUSTER.format(gap=72 * 3600))
def session_clusters_72h(s, d):
    return changes.latest_sessions(table(s, d, "events"), 72 * 3600)


@query(_CLUSTER.format(gap=24 * 3600))
def session_clusters_24h(s, d):
    return changes.latest_sessions(table(s, d, "events"), 24 * 3600)


@query("SELECT user_id AS file, event_type AS name, event_id % 3 AS target, round(least(1.0::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * (count(*) - 1)), 6) AS confidence FROM events GROUP BY ALL")
def learned_confidence(s, d):
    seen = table(s, d, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("name"), (F.col("event_id") % 3).alias("target"))
    return changes.learned_confidence(seen).withColumn("confidence", F.round("confidence", 6))


@query("SELECT coalesce(u.id, f.id) AS id, coalesce(f.path, NULL) AS path, CASE WHEN u.id IS NOT NULL THEN u.language ELSE f.language END AS language FROM (SELECT * FROM files WHERE language <> 'es') f FULL JOIN (SELECT id, 'xx' AS language FROM files WHERE repo = 'src8' OR language = 'es') u ON f.id = u.id", "files")
def merge_upsert(s, d):
    f = A.files(s, d).select("id", "path", "language")
    return changes.merge(f.where("language <> 'es'"), A.files(s, d).where("repo = 'src8' or language = 'es'").select("id", F.lit("xx").alias("language")), "id")


@query("SELECT src, dst FROM calls WHERE src NOT IN (SELECT id FROM symbols WHERE file = 'Brand#25') AND dst NOT IN (SELECT id FROM symbols WHERE file = 'Brand#25')", "calls symbols")
def detach_delete(s, d):
    g = PropertyGraph({"Symbol": A.symbols(s, d)}, {"CALLS": A.calls(s, d)})
    return g.without(A.symbols(s, d).where("file = 'Brand#25'")).edges["CALLS"].select("src", "dst")


@query("SELECT DISTINCT src, dst FROM calls WHERE src IN (SELECT id FROM symbols WHERE complexity > 10) AND dst IN (SELECT id FROM symbols WHERE complexity > 10)", "calls symbols")
def checked_edges(s, d):
    return PropertyGraph({"Symbol": A.symbols(s, d).where("complexity > 10")}, {"CALLS": A.calls(s, d)}).checked().edges["CALLS"]


_SIGNALS = ", ".join(f"sum({' + '.join([f'CASE WHEN regexp_matches(lower(text), {chr(39)}{p}{chr(39)}) THEN {w} ELSE 0 END' for p, t, w in changes.SIGNALS if t == n])})::BIGINT AS {n}" for n in changes.TYPES)


@query(f"WITH c AS (SELECT conv_id, {_SIGNALS} FROM conversations GROUP BY conv_id), b AS (SELECT *, greatest({', '.join(changes.TYPES)}) AS score FROM c) SELECT conv_id AS change, CASE WHEN score = 0 THEN 'Mixed' " + " ".join(f"WHEN {t} = score THEN '{t}'" for t in changes.TYPES) + " END AS type, score FROM b")
def pr_type_score(s, d):
    return changes.change_type(table(s, d, "conversations").select(F.col("conv_id").alias("change"), F.col("text").alias("subject")))


_METRIC = "SELECT {k} AS metric, count(*) AS value FROM lineitem WHERE {w} GROUP BY 1"


@query("WITH n AS (SELECT l_returnflag || l_linestatus AS metric, count(*) AS value FROM lineitem GROUP BY 1), o AS (SELECT l_returnflag || l_linestatus AS metric, count(*) AS baseline FROM lineitem WHERE l_quantity > 2 GROUP BY 1), p AS (SELECT *, (value - baseline) * 100.0 / baseline AS pc FROM n JOIN o USING (metric)), t AS (SELECT *, CAST(trunc(pc) AS BIGINT) AS whole FROM p) SELECT metric, baseline, value, CASE WHEN whole = 0 THEN 'same' ELSE (CASE WHEN whole > 0 THEN '+' ELSE '' END) || whole || '%' END AS change, CASE WHEN metric = 'AF' THEN pc > 2 ELSE pc < -2 END AS regression FROM t")
def quality_compare(s, d):
    rows = table(s, d, "lineitem")
    count = lambda r: r.groupBy(F.concat("l_returnflag", "l_linestatus").alias("metric")).agg(F.count("*").alias("value"))
    return changes.compare_quality(count(rows), count(rows.where("l_quantity > 2")), ["AF"])


@query("WITH f AS (SELECT dst, count(DISTINCT src) AS value FROM calls GROUP BY dst), n AS (SELECT name, id, value FROM symbols JOIN f ON dst = id), m AS (SELECT name, list_sort(list(value)) AS v FROM n GROUP BY name HAVING count(*) >= 5) SELECT name, id, value, v[len(v) // 2 + 1] AS median FROM n JOIN m USING (name) WHERE abs(value - v[len(v) // 2 + 1]) > 2".replace("WITH ", "WITH " + A.SQL["calls"] + ", " + A.SQL["symbols"] + ", ", 1))
def caller_median_outliers(s, d):
    f = A.calls(s, d).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("value"))
    return changes.outliers(A.symbols(s, d).join(f, "id").select("name", "id", "value"))


# --- communities and streams --------------------------------------------------------------------------------------------

@query(None)
def louvain(s, d):
    e = materialize(A.calls(s, d), "calls")
    return graph.louvain(e, A.symbols(s, d))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(s, d):
    return streams.windowed(table(s, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([time_bucket(INTERVAL 30 minute, ts), time_bucket(INTERVAL 30 minute, ts) - INTERVAL 30 minute]) AS start, event_type, value FROM events) GROUP BY ALL")
def event_sliding(s, d):
    return streams.windowed(table(s, d, "events"), "1 hour", "30 minutes").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 7200 * 1000000::BIGINT THEN 0 ELSE 1 END AS cut FROM events),
c AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 hour AS stop, count(*) AS n FROM c GROUP BY user_id, grp""")
def event_session(s, d):
    return streams.sessions(table(s, d, "events"), "2 hours")
