"""More queries of the code-graph operators on the driver's tables, each beside its SQL: symbols, rules, reviews, repositories, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweave.functions import bridges, routes, scalars
from codeweave.functions.rules import SECURITY, security_rules
from codeweave.operators import changes, patterns, repos, review, sinks, symbols, text, vectors
from codeweave.plans.catalog import _BM25, _VEC, WORDS, _query_vector, _vectors, query
from codeweave.plans.graph import PropertyGraph
from codeweave.session import materialize
from codeweave.sources import adapters as A
from codeweave.sources.adapters import table, with_tables

_RENAMED = "imports AS (SELECT DISTINCT a.file, b.file AS target_file FROM calls JOIN units a ON a.id = src JOIN units b ON b.id = dst WHERE a.kind = 'Route' AND a.file <> b.file)"


def _imports(s, d):
    """Files that routes of a file call into count as imported by it."""
    u = A.units(s, d)
    e = A.calls(s, d).join(u.where("kind = 'Route'").select(F.col("id").alias("src"), "file"), "src").join(u.select(F.col("id").alias("dst"), F.col("file").alias("target_file")), "dst")
    return e.where("file <> target_file").select("file", "target_file").distinct()


# --- symbols --------------------------------------------------------------------------------------------------------------

@query("SELECT id, name, kind, start_line, end_line FROM units WHERE file = 'Brand#2'", "units")
def symbols_in_file(s, d):
    return symbols.in_file(A.units(s, d), "Brand#2").select("id", "name", "kind", "start_line", "end_line")


@query("SELECT id, name, kind, file FROM units WHERE id = 17", "units")
def symbol_by_id(s, d):
    return PropertyGraph({"Symbol": A.units(s, d)}, {}).cypher("MATCH (n:Symbol) WHERE n.id = 17 RETURN n.id AS id, n.name AS name, n.kind AS kind, n.file AS file")


@query("SELECT id, name, file, start_line FROM units WHERE visibility = 'public' OR kind = 'Route'", "units")
def api_surface(s, d):
    return symbols.api_surface(A.units(s, d)).select("id", "name", "file", "start_line")


@query("SELECT DISTINCT dst AS symbol, src AS caller, name, file, start_line FROM calls JOIN units ON src = id", "calls units")
def references(s, d):
    return symbols.references(A.calls(s, d), A.units(s, d))


@query(with_tables("calls units", ", p AS (SELECT a.file AS a, b.file AS b, count(*) AS edges FROM (SELECT DISTINCT src, dst FROM calls) JOIN units a ON a.id = src JOIN units b ON b.id = dst WHERE a.file <> b.file GROUP BY ALL) SELECT a AS file, 'out' AS direction, b AS other, edges FROM p UNION ALL SELECT b, 'in', a, edges FROM p"))
def file_dependencies(s, d):
    return symbols.file_dependencies(A.calls(s, d), A.units(s, d))


@query(with_tables("calls units", """, e AS (SELECT DISTINCT src, dst FROM calls),
i AS (SELECT dst AS id, array_to_string(list_slice(list_sort(list(src)), 1, 50), ',') AS callers, count(*) AS n_callers FROM e GROUP BY dst),
o AS (SELECT src AS id, array_to_string(list_slice(list_sort(list(dst)), 1, 50), ',') AS callees, count(*) AS n_callees FROM e GROUP BY src)
SELECT id, name, parent, docstring, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees, coalesce(n_callers, 0) AS n_callers, coalesce(n_callees, 0) AS n_callees FROM units LEFT JOIN i USING (id) LEFT JOIN o USING (id)"""))
def symbol_context(s, d):
    out = symbols.context(A.units(s, d), A.calls(s, d))
    return out.withColumn("callers", F.array_join("callers", ",")).withColumn("callees", F.array_join("callees", ","))


_INHERITED = """, {imports}, raw AS (SELECT id AS src, 'ring' AS word, name, file FROM units WHERE kind = 'Class'),
asked AS (SELECT r.src, t.name, r.file FROM raw r JOIN (SELECT DISTINCT name FROM units WHERE kind IN ('Class', 'Interface')) t ON t.name = r.name OR t.name = replace(r.name, 'ring', 'bolt') WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.file = r.file AND u.name = t.name)),
c AS (SELECT a.src, a.file, u.id, u.kind, u.file AS target_file FROM asked a JOIN units u ON u.name = a.name AND u.kind IN ('Class', 'Interface') AND u.file <> a.file {where}),
r AS (SELECT src, id, CASE WHEN EXISTS (SELECT 1 FROM imports i WHERE i.file = c.file AND i.target_file = c.target_file) THEN 1 WHEN kind = 'Interface' THEN 2 ELSE 3 END AS rank FROM c)
SELECT src, min(rank * 1000000000000 + id) % 1000000000000 AS dst FROM r GROUP BY src"""


def _base_names(s, d):
    """Classes and the type names that they name: a name of the tables itself, with another noun."""
    u = A.units(s, d)
    known = u.where("kind in ('Class', 'Interface')").select("name").distinct()
    raw = u.where("kind = 'Class'").select(F.col("id").alias("src"), F.explode(F.array_distinct(F.array("name", F.replace("name", F.lit("ring"), F.lit("bolt"))))).alias("name"), "file")
    return raw.join(known, "name", "left_semi")


@query(with_tables("calls units", _INHERITED.format(imports=_RENAMED, where="")))
def inherits_resolved(s, d):
    return symbols.resolve_inherits(_base_names(s, d), A.units(s, d), _imports(s, d))


@query(with_tables("calls units", _INHERITED.format(imports=_RENAMED, where="WHERE a.file IN ('Brand#2', 'Brand#3')")))
def inherits_resolved_again(s, d):
    changed = A.units(s, d).where("file in ('Brand#2', 'Brand#3')").select("file")
    return symbols.resolve_inherits(_base_names(s, d), A.units(s, d), _imports(s, d), changed)


@query(with_tables("units", ", w AS (SELECT DISTINCT split_part(docstring, ' ', 1) AS probe, 'Brand#2' AS file FROM units), m AS (SELECT probe, id, row_number() OVER (PARTITION BY probe ORDER BY id) AS r FROM w JOIN units u ON contains(u.name, probe) AND u.name <> probe AND u.file <> w.file) SELECT probe, id FROM m WHERE r <= 5"))
def similar_names(s, d):
    probes = A.units(s, d).select(F.split_part("docstring", F.lit(" "), F.lit(1)).alias("probe"), F.lit("Brand#2").alias("file")).distinct()
    return symbols.similar_names(A.units(s, d), probes)


@query("SELECT kind AS cluster, count(DISTINCT id) AS size, array_to_string(list_slice(list_sort(list(DISTINCT file)), 1, 5), ', ') AS description FROM units GROUP BY kind", "units")
def cluster_summary(s, d):
    return symbols.clusters(A.units(s, d).withColumnRenamed("kind", "cluster"))


@query("SELECT file, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT name)), 1, 3), ', ') AS names FROM units GROUP BY file", "units")
def file_previews(s, d):
    return symbols.previews(A.units(s, d), "file", "name")


@query("SELECT file || '::' || name AS id, arg_min(kind, (CASE WHEN kind = 'Test' THEN 0 ELSE 1 END) * 1000000000 + id) AS kind FROM units GROUP BY file, name", "units")
def duplicates_kept_first(s, d):
    return symbols.kept_first(A.units(s, d).select(F.concat("file", F.lit("::"), "name").alias("id"), "kind", F.col("id").alias("at"))).select("id", "kind")


@query("SELECT id, kind || ' ' || name || '(' || complexity || ')' || ' in ' || file || ' [sql]' || ': ' || docstring AS text FROM units", "units")
def embedding_texts(s, d):
    return A.units(s, d).select("id", scalars.rich_text(F.col("kind"), F.col("name"), F.concat(F.lit("("), "complexity", F.lit(")")), F.lit(""), F.col("file"), F.lit("sql"), F.col("docstring")).alias("text"))


@query("SELECT id FROM units WHERE kind = 'Test' OR lower(name) LIKE 'test%'", "units")
def test_symbols(s, d):
    return A.units(s, d).where(scalars.is_test(F.col("name"), F.col("kind"), F.col("file"))).select("id")


@query("SELECT a.file, b.file AS other FROM (SELECT DISTINCT file FROM units) a, (SELECT DISTINCT file FROM units) b WHERE a.file = b.file AND regexp_matches(lower(a.file), '^brand#[^/]2[^/]*$')", "units")
def files_by_glob(s, d):
    return A.units(s, d).select("file").distinct().where(scalars.matches_glob(F.col("file"), "brand#?2*")).select("file", F.col("file").alias("other"))


# --- routes, rules and languages ------------------------------------------------------------------------------------------

@query(with_tables("units", """, h AS (SELECT id, name, lower(name) AS low, file || '.py' AS file FROM units WHERE kind IN ('Function', 'Method'))
SELECT CASE WHEN regexp_matches(low, '^get_') THEN 'GET' ELSE 'POST' END AS method, '/' || replace(regexp_replace(low, '^get_', ''), '_', '/') AS path, id AS handler_id, file, 'generic_python' AS framework FROM h WHERE regexp_matches(low, '^get_')"""))
def routes_python(s, d):
    u = A.units(s, d).select(F.col("id"), "name", "kind", F.concat("file", F.lit(".py")).alias("file"), "docstring")
    return routes.routes(u)


@query("SELECT CASE WHEN complexity >= 25 THEN 'POST' ELSE 'GET' END AS method, '/' || id || '/x' AS path, id AS handler_id, file, CASE WHEN complexity >= 25 THEN 'flask' ELSE 'spring' END AS framework FROM units WHERE kind IN ('Function', 'Method')", "units")
def routes_told(s, d):
    doc = F.when(F.col("complexity") >= 25, F.concat(F.lit("@app.route('/"), "id", F.lit("/x') Post it"))).otherwise(F.concat(F.lit('GetMapping("/'), "id", F.lit('/x")')))
    return routes.routes(A.units(s, d).withColumn("docstring", doc))


@query(with_tables("units", ", m AS (SELECT r.id AS src, c.id, c.start_line FROM units r JOIN units c ON r.file = c.file AND r.kind = 'Route' AND c.kind IN ('Function', 'Method') AND c.start_line <= r.end_line AND c.end_line >= r.start_line) SELECT src, min(start_line::BIGINT * 1000000000 + id) % 1000000000 AS dst FROM m GROUP BY src"))
def route_handlers(s, d):
    return routes.handler_edges(A.units(s, d))


@query("SELECT DISTINCT page_id, path FROM (SELECT page_id, unnest(regexp_extract_all(html, '[\"''](/[^\"''\\s]{1,198})[\"'']', 1)) AS path FROM pages) WHERE NOT starts_with(path, '//')")
def quoted_paths(s, d):
    return routes.quoted_paths(table(s, d, "pages").select("page_id", "html"), "html")


@query("SELECT id, CASE WHEN regexp_matches(lower(name), '^(get|list|find|fetch|read|show|index)') THEN 'GET' WHEN regexp_matches(lower(name), '^(create|add|post|save|new)') THEN 'POST' END AS verb, '/' || lower(replace(name, '_', '/')) AS path FROM units", "units")
def name_routes(s, d):
    return A.units(s, d).select("id", scalars.http_verb(F.col("name")).alias("verb"), scalars.name_to_path(F.col("name")).alias("path"))


@query("SELECT page_id, '/' || regexp_replace(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1)), '\\.(tsx?|jsx?|py|go|rs)$', '') AS route FROM pages WHERE NOT regexp_matches(url, '(?i)/api/')")
def file_routes(s, d):
    p = table(s, d, "pages").where("not rlike(url, '(?i)/api/')")
    return p.select("page_id", routes.path_of_file(F.regexp_replace("url", "[?#].*$", "")).alias("route"))


@query(with_tables("files", ", " + A.SQL["code"] + """, ln AS (SELECT path, extension, unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM code)
SELECT path, line::BIGINT AS line, 'CTYPES' AS kind, regexp_extract(content, 'CDLL\\(\"([^\"]*)', 1) AS foreign_symbol, 'python' AS source_language, 'c' AS target_language, trim(content) AS detail FROM ln WHERE extension = 'py' AND contains(content, 'ctypes.CDLL(')
UNION ALL SELECT path, line, 'WASM', regexp_extract(content, '\\(([^,)]*)', 1), 'javascript', 'wasm', trim(content) FROM ln WHERE extension = 'js' AND contains(content, 'WebAssembly.instantiate(')
UNION ALL SELECT path, line, 'JNI', regexp_extract(content, '\\(\"([^\"]*)', 1), 'java', 'c', trim(content) FROM ln WHERE extension = 'java' AND contains(content, 'System.loadLibrary(')
UNION ALL SELECT path, line, 'JNI', regexp_extract(regexp_replace(trim(content), '[^\\p{L}\\p{N}_:]+$', ''), '([\\p{L}\\p{N}_:][^\\s]*)$', 1), 'java', 'c', trim(content) FROM ln WHERE extension = 'java' AND contains(content, 'native ')
UNION ALL SELECT path, line, 'CGO', 'C', 'go', 'c', trim(content) FROM ln WHERE extension = 'go' AND contains(content, 'import "C"')
UNION ALL SELECT path, line, 'CGO', 'C.' || regexp_extract(content, 'C\\.([\\p{L}\\p{N}_]*)', 1), 'go', 'c', trim(content) FROM ln WHERE extension = 'go' AND contains(content, 'C.')"""))
def bridge_scan(s, d):
    return bridges.bridge_scan(A.code(s, d))


@query(with_tables("files", ", " + A.SQL["code"] + ", ln AS (SELECT path, extension, unnest(string_split(content, chr(10))) AS content FROM code), rules(rule_id, category, severity, extensions, pattern, exclude) AS (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (r, cat, sev, f" {ext} " if ext else "", pat.lower(), ex.lower())) + ")" for r, cat, sev, ext, pat, ex in SECURITY) + ") SELECT severity, count(*) AS findings, count(DISTINCT path) AS files FROM ln JOIN rules ON contains(lower(content), pattern) WHERE (extensions = '' OR contains(extensions, ' ' || extension || ' ')) AND NOT (exclude <> '' AND contains(lower(content), exclude)) GROUP BY severity"))
def rule_severities(s, d):
    return text.rule_scan(A.code(s, d), security_rules(s)).groupBy("severity").agg(F.count("*").alias("findings"), F.count_distinct("path").alias("files"))


@query(with_tables("files", ", " + A.SQL["code"] + " SELECT id, CASE WHEN extension = 'py' AND regexp_matches(content, '(?m)^lib = ') THEN 'python-ffi' WHEN extension = 'js' AND regexp_matches(content, 'eval') THEN 'script' ELSE language END AS language FROM code"))
def probed_languages(s, d):
    return symbols.probed_language(A.code(s, d), [("py", "(?m)^lib = ", "python-ffi"), ("js", "eval", "script")]).select("id", "language")


@query("SELECT event_id, CASE WHEN value >= 9 THEN 'CRITICAL' WHEN value >= 7 THEN 'HIGH' WHEN value >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity, regexp_replace('^>=' || value, '^[^0-9]+', '') AS version FROM events")
def severities(s, d):
    return table(s, d, "events").select("event_id", scalars.vulnerability_severity(F.col("value").cast("string")).alias("severity"), scalars.clean_version(F.concat(F.lit("^>="), F.col("value").cast("string"))).alias("version"))


_ADVISORIES = "dep AS (SELECT p_brand AS ecosystem, p_name AS name, p_size AS version FROM part), adv AS (SELECT 'A' || p_partkey AS advisory_id, p_brand AS ecosystem, p_name AS name, p_size AS version, CASE WHEN p_retailprice >= 990 THEN 'CRITICAL' WHEN p_retailprice >= 970 THEN 'HIGH' ELSE 'LOW' END AS severity FROM part WHERE p_retailprice >= 950)"


def _vulnerable(s, d):
    p = table(s, d, "part")
    dependencies = p.select(F.col("p_brand").alias("ecosystem"), F.col("p_name").alias("name"), F.col("p_size").alias("version"))
    price = F.col("p_retailprice")
    severity = F.when(price >= 990, "CRITICAL").when(price >= 970, "HIGH").otherwise("LOW").alias("severity")
    advisories = p.where("p_retailprice >= 950").select(F.concat(F.lit("A"), "p_partkey").alias("advisory_id"), F.col("p_brand").alias("ecosystem"), F.col("p_name").alias("name"), F.col("p_size").alias("version"), severity)
    return repos.vulnerable(dependencies, advisories)


@query(f"WITH {_ADVISORIES} SELECT ecosystem, name, version, advisory_id, severity, count(*) AS n FROM dep JOIN adv USING (ecosystem, name, version) GROUP BY ALL")
def vulnerable_dependencies(s, d):
    return _vulnerable(s, d).groupBy("ecosystem", "name", "version", "advisory_id", "severity").agg(F.count("*").alias("n"))


@query(f"WITH {_ADVISORIES} SELECT advisory_id, severity, count(*) AS n FROM dep JOIN adv USING (ecosystem, name, version) WHERE severity IN ('CRITICAL', 'HIGH') AND ecosystem = 'Brand#2' GROUP BY ALL")
def vulnerable_at_least_high(s, d):
    return repos.filtered(_vulnerable(s, d), "HIGH", "Brand#2").groupBy("advisory_id", "severity").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS xml, sha256(replace(replace(replace(replace(text, '\\', '\\\\'), '''', '\\'''), chr(10), '\\n'), chr(13), '\\r')) AS cypher FROM documents")
def escapes(s, d):
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", F.sha2(scalars.xml_escape(t), 256).alias("xml"), F.sha2(scalars.cypher_escape(t), 256).alias("cypher"))


# --- recommendations, reviews, changes ------------------------------------------------------------------------------------

@query("SELECT 'split_file' AS kind, file AS target, CASE WHEN max(end_line) > 2000 OR count(*) > 80 THEN 'High' ELSE 'Medium' END AS impact, CASE WHEN count(*) > 60 THEN 'High' ELSE 'Medium' END AS effort FROM units GROUP BY file HAVING max(end_line) > 1000 OR count(*) > 40", "units")
def size_recommendations(s, d):
    return review.size_recommendations(A.units(s, d))


@query(with_tables("units", """, d AS (SELECT id, name, file FROM units WHERE kind = 'Test'), g AS (SELECT file, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT name)), 1, 5), ', ') AS names FROM d GROUP BY file)
SELECT 'remove_dead_code' AS kind, file || ': ' || names AS target, 'Low' AS impact, 'Low' AS effort FROM g WHERE n >= 3 UNION ALL SELECT 'remove_dead_code', CAST(id AS VARCHAR), 'Low', 'Low' FROM d WHERE file IN (SELECT file FROM g WHERE n < 3)"""))
def dead_code_recommendations(s, d):
    return review.dead_code_recommendations(A.units(s, d).where("kind = 'Test'").select("id", "name", "file"))


@query(with_tables("calls units", """, r AS (SELECT 'simplify_logic' AS kind, CAST(id AS VARCHAR) AS target, CASE WHEN complexity > 20 THEN 'High' ELSE 'Medium' END AS impact, CASE WHEN complexity > 30 THEN 'High' ELSE 'Medium' END AS effort FROM (SELECT * FROM units WHERE complexity >= 15 ORDER BY complexity DESC, id LIMIT 10)
UNION ALL SELECT 'reduce_fan_out', CAST(src AS VARCHAR), CASE WHEN n > 25 THEN 'High' ELSE 'Medium' END, 'Medium' FROM (SELECT src, count(DISTINCT dst) AS n FROM calls GROUP BY src ORDER BY n DESC, src LIMIT 20) WHERE n >= 15
UNION ALL SELECT 'reduce_fan_in', CAST(dst AS VARCHAR), 'High', 'High' FROM (SELECT dst, count(DISTINCT src) AS n FROM calls GROUP BY dst ORDER BY n DESC, dst LIMIT 20) WHERE n >= 20)
SELECT *, CAST((CASE impact WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) * (CASE effort WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END) AS INTEGER) AS priority FROM r ORDER BY priority DESC, kind, target LIMIT 25"""))
def prioritised(s, d):
    every = review.complexity_recommendations(A.units(s, d)).withColumn("target", F.col("target").cast("string")).unionByName(review.coupling_recommendations(A.calls(s, d)))
    return review.prioritised(every, 25)


@query(with_tables("units", """
SELECT 'dead_code' AS "check", CAST(count(*) AS DOUBLE) AS value, count(*) <= 100 AS passed FROM units WHERE kind = 'Test' UNION ALL SELECT 'coverage', 55.0, true"""))
def ci_gates(s, d):
    found = text.rule_scan(A.code(s, d), security_rules(s))
    covered = s.createDataFrame([(55,)], "percent long")
    return review.gates(found, A.units(s, d).where("kind = 'Test'"), covered, max_dead=100, least_coverage=50).where("check <> 'security'")


@query("SELECT o.o_orderkey AS commit, o.o_orderstatus AS author, s.id FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN spans s ON s.file = l.l_suppkey AND s.start_line <= l.l_linenumber AND s.end_line >= l.l_linenumber WHERE o.o_orderstatus = 'F' GROUP BY ALL", "spans")
def commit_symbols(s, d):
    commits = table(s, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderstatus").alias("author"))
    hunks = table(s, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").cast("string").alias("file"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"))
    return symbols.commit_symbols(commits, hunks, A.spans(s, d).withColumn("file", F.col("file").cast("string")), author="F")


@query("SELECT doc_id AS commit, source AS file, doc_id + 1 AS start_line, doc_id + 3 AS end_line FROM documents UNION ALL SELECT doc_id, source, 7, 7 FROM documents")
def diff_hunks(s, d):
    body = F.concat(F.lit("--- a/x\n+++ b/"), "source", F.lit("\n@@ -1,2 +"), F.col("doc_id") + 1, F.lit(",3 @@ fn\n+a\n@@ -9 +7 @@\n-b"))
    return changes.hunks(table(s, d, "documents").select(F.col("doc_id").alias("commit"), body.alias("text")))


@query(with_tables("snapshots", """, b AS (SELECT file, name, kind, o.hash AS before, n.hash AS after FROM old o FULL JOIN new n USING (file, name, kind)),
r AS (SELECT file, name, kind, 'REMOVED' AS change FROM b WHERE after IS NULL AND NOT EXISTS (SELECT 1 FROM b a JOIN old o ON o.name = a.name AND o.kind = a.kind AND o.file <> a.file WHERE a.before IS NULL AND a.name = b.name AND a.kind = b.kind))
SELECT file, name, kind, change FROM r ORDER BY file, name, kind LIMIT 20"""))
def changes_in_order(s, d):
    return symbols.ordered_changes(changes.semantic_diff(*A.snapshots(s, d)), 20).select("file", "name", "kind", "change")


@query(with_tables("calls units", """, touched AS (SELECT * FROM units WHERE file = 'Brand#2' AND kind IN ('Function', 'Class', 'Route')),
up(id) AS (SELECT src FROM calls WHERE dst IN (SELECT id FROM touched) UNION SELECT e.src FROM up JOIN calls e ON e.dst = up.id),
blast AS (SELECT * FROM units WHERE id IN (SELECT id FROM up) ORDER BY file, name, id LIMIT 60)
SELECT 'changed' AS section, file, name, 'MODIFIED' AS detail FROM (SELECT DISTINCT file, name, kind FROM touched)
UNION ALL SELECT 'blast_radius', file, name, kind FROM blast
UNION ALL SELECT 'affected_tests', file, name, kind FROM blast WHERE kind = 'Test' OR lower(name) LIKE 'test%'
UNION ALL SELECT 'api_surface', file, name, kind FROM touched WHERE visibility = 'public' OR kind = 'Route'
UNION ALL SELECT 'security', file, 'SEC', 'High:' || id FROM (SELECT id, file FROM units WHERE kind = 'Test' AND file = 'Brand#2')
UNION ALL SELECT 'complexity', file, name, CAST(complexity AS VARCHAR) FROM units WHERE file = 'Brand#2' AND complexity >= 10
UNION ALL SELECT 'dead_code', file, name, kind FROM units WHERE file = 'Brand#2' AND kind IN ('Function', 'Method') AND id NOT IN (SELECT dst FROM calls)"""))
def review_report(s, d):
    u = A.units(s, d)
    diff = u.where("file = 'Brand#2' and kind in ('Function', 'Class', 'Route')").select("file", "name", "kind", F.lit("MODIFIED").alias("change")).distinct()
    found = u.where("kind = 'Test'").select(F.col("file").alias("path"), F.col("id").alias("line"), F.lit("SEC").alias("rule_id"), F.lit("High").alias("severity"))
    return review.report(diff, u, A.calls(s, d), found, limit=60)


@query("WITH f AS (SELECT source AS change, lang || '/' || doc_id || CASE lang WHEN 'en' THEN '.md' ELSE '_test.py' END AS file, CASE lang WHEN 'en' THEN 'ADDED' ELSE 'REMOVED' END AS k FROM documents), a AS (SELECT change, count(*) AS files, count(DISTINCT split_part(file, '/', 1)) AS folders, count(*) FILTER (WHERE k = 'REMOVED') AS t, count(*) FILTER (WHERE k = 'ADDED') AS d FROM f GROUP BY change) SELECT change, CASE WHEN d > 0.7 * files THEN 'Docs' WHEN t > 0.7 * files THEN 'Test' WHEN d > 0.5 * files THEN 'Feature' WHEN t > 0.3 * files THEN 'Refactor' ELSE 'Mixed' END AS type, CASE WHEN folders <= 2 THEN 'Standalone' ELSE 'CrossModule' END AS scope, files, files AS symbols FROM a")
def change_contexts(s, d):
    kind = F.col("lang") == "en"
    f = table(s, d, "documents").select(F.col("source").alias("change"), F.concat("lang", F.lit("/"), "doc_id", F.when(kind, ".md").otherwise("_test.py")).alias("file"), F.when(kind, "ADDED").otherwise("REMOVED").alias("kind_of_change"))
    subjects = f.select("change", F.lit("wip").alias("subject")).distinct()
    return changes.change_context(subjects, f, f)


@query("SELECT s.id, s.file AS repo, c.file AS other, count(DISTINCT c.id) AS callers FROM units s JOIN calls ON dst = s.id JOIN units c ON c.id = src WHERE s.kind = 'Interface' AND s.file <> c.file GROUP BY ALL", "calls units")
def repo_callers(s, d):
    u = A.units(s, d).withColumn("repo", F.col("file"))
    return symbols.repo_callers(u.where("kind = 'Interface'"), A.calls(s, d), u)


@query(with_tables("units", ", c AS (SELECT docstring AS name, id, kind, file AS repo FROM (SELECT split_part(docstring, ' of ', 1) AS docstring, id, kind, file FROM units)), f AS (SELECT name, first(kind ORDER BY repo, id) AS usual FROM c GROUP BY name HAVING count(DISTINCT repo) >= 3) SELECT name, id, kind, usual FROM c JOIN f USING (name) WHERE kind <> usual"))
def uneven_changes(s, d):
    c = A.units(s, d).select(F.split_part("docstring", F.lit(" of "), F.lit(1)).alias("name"), "id", "kind", F.col("file").alias("repo"))
    return symbols.uneven(c)


@query("SELECT DISTINCT dst AS src, src AS dst FROM calls WHERE (dst, src) NOT IN (SELECT (src, dst) FROM calls)", "calls")
def bridges_promoted(s, d):
    e = A.calls(s, d)
    return symbols.promoted(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), e)


@query("SELECT DISTINCT a.page_id AS module, b.doc_id AS dependency FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages) a JOIN (SELECT doc_id, CAST(doc_id AS VARCHAR) AS base FROM documents) b USING (base)")
def manifest_edges(s, d):
    return symbols.manifest_edges(table(s, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path")), table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("m/"), "doc_id").alias("manifest")))


# --- patterns, repositories, exports, retrieval ---------------------------------------------------------------------------

@query(with_tables("calls units", """, inh AS (SELECT DISTINCT src, dst FROM calls JOIN units a ON a.id = src JOIN units b ON b.id = dst WHERE a.kind = 'Class' AND b.kind = 'Interface'),
m AS (SELECT src AS id, count(DISTINCT dst) AS n FROM calls WHERE dst IN (SELECT id FROM units WHERE kind IN ('Class', 'Function')) AND dst IN (SELECT src FROM inh) GROUP BY src)
SELECT 'Factory' AS pattern, CAST(u.id AS VARCHAR) AS id, CASE WHEN regexp_matches(lower(name), 'create|build|make|factory|new_') THEN 'high' ELSE 'medium' END AS confidence, CAST(n AS VARCHAR) AS evidence FROM units u JOIN m USING (id) WHERE kind = 'Method'
UNION ALL SELECT 'Strategy', CAST(dst AS VARCHAR), CASE WHEN count(*) >= 5 THEN 'high' ELSE 'medium' END, CAST(count(*) AS VARCHAR) FROM inh GROUP BY dst HAVING count(*) >= 3"""))
def pattern_matches(s, d):
    u, e = A.units(s, d), A.calls(s, d)
    kind = lambda x, k: u.where(F.col("kind") == k).select(F.col("id").alias(x))
    inherited = e.distinct().join(kind("src", "Class"), "src", "left_semi").join(kind("dst", "Interface"), "dst", "left_semi")
    return patterns.detect(u, e, inherited, ["Factory", "Strategy"]).withColumn("id", F.col("id").cast("string"))


@query("WITH g AS (SELECT r_name AS repo, n_nationkey AS id, n_name AS name, c_custkey AS src FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey) SELECT DISTINCT '[' || repo || ']::' || id AS id, name, repo FROM g")
def combined_graph(s, d):
    nation, region = table(s, d, "nation"), table(s, d, "region").collect()
    parts = {r["r_name"]: nation.where(F.col("n_regionkey") == r["r_regionkey"]).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")) for r in region}
    nodes, _ = repos.combined(parts, {k: t.select(F.col("id").alias("src"), F.col("id").alias("dst")) for k, t in parts.items()})
    return nodes.select("id", "name", "repo")


@query("WITH r AS (SELECT *, upper(split_part(url, '/', 4)) AS m FROM pages) SELECT split_part(url, '/', 3) AS service, m AS method, '/' || split_part(url, '/', 5) AS path, min(page_id) AS symbol_id FROM r GROUP BY ALL")
def contracts_offered(s, d):
    part = lambda k: F.split_part("url", F.lit("/"), F.lit(k))
    sym = table(s, d, "pages").select(F.col("page_id").alias("id"), F.concat(part(4), F.lit(" /"), part(5)).alias("name"), F.lit("Route").alias("kind"), part(3).alias("repo"), F.lit("f").alias("file"))
    return repos.contracts(sym).select("service", "method", "path", "symbol_id")


@query("WITH p AS (SELECT page_id, split_part(url, '/', 3) AS host, regexp_replace(regexp_replace(regexp_replace(url, '/+$', ''), '^https?://[^/]*', ''), '/[:{<][^/]*', '/*', 'g') AS route FROM pages WHERE NOT contains(url, '/api/')) SELECT DISTINCT a.host AS caller, a.page_id AS src, b.host AS service, b.page_id AS symbol_id, a.route AS path FROM p a JOIN p b ON a.route = b.route AND a.host <> b.host")
def service_links(s, d):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    p = table(s, d, "pages").where("not contains(url, '/api/')")
    offered = p.select(host.alias("service"), F.col("page_id").alias("symbol_id"), F.col("url").alias("path"))
    return repos.service_calls(p.select(host.alias("caller"), F.col("page_id").alias("src"), "url"), offered)


@query("SELECT 'CREATE (:Symbol {id: ''' || id || ''', name: ''' || replace(replace(name, '\\', '\\\\'), '''', '\\''') || '''});' AS value FROM people UNION ALL SELECT 'MATCH (a:Symbol {id: ''' || src || '''}), (b:Symbol {id: ''' || dst || '''}) CREATE (a)-[:INHERITS]->(b);' FROM inherits", "people inherits")
def export_cypher(s, d):
    return sinks.cypher_script(A.people(s, d).select("id", "name"), A.inherits(s, d), "Symbol", "INHERITS")


@query("SELECT 1 AS part, '<node id=\"' || id || '\"><data key=\"name\">' || replace(name, '&', '&amp;') || '</data></node>' AS value FROM people UNION ALL SELECT 2, '<edge source=\"' || src || '\" target=\"' || dst || '\"></edge>' FROM inherits", "people inherits")
def export_graphml(s, d):
    return sinks.graphml_rows(A.people(s, d).select("id", "name"), A.inherits(s, d)).where("part in (1, 2)")


@query("SELECT 'nodes' AS part, '{\"id\":\"' || id || '\",\"name\":\"' || name || '\"}' AS value FROM people UNION ALL SELECT 'edges', '{\"src\":\"' || src || '\",\"dst\":\"' || dst || '\"}' FROM inherits", "people inherits")
def export_json(s, d):
    return sinks.json_rows(A.people(s, d).select("id", "name"), A.inherits(s, d))


@query("SELECT id, CAST(CASE WHEN language = 'en' THEN length(content) ELSE 0 END AS DOUBLE) AS first FROM files WHERE language <> 'es' OR repo <> 'src8'", "files")
def embeddings_refreshed(s, d):
    f = A.files(s, d)
    stored = f.where("language <> 'en'").select("id", F.array(F.lit(0.0)).alias("embedding"))
    texts = f.where("language <> 'es' or repo <> 'src8'").select("id", F.col("path").alias("file"), F.col("content").alias("text"))
    changed = f.where("language = 'en'").select(F.col("path").alias("file"))
    out = sinks.refreshed_embeddings(stored, texts, changed, lambda c: F.array(F.length(c).cast("double")))
    return out.select("id", F.col("embedding")[0].alias("first"))


@query("SELECT event_id AS id, ts AS created_at FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 2 DAY FROM events)")
def sessions_purged(s, d):
    events = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    first = events.agg(F.min("created_at")).first()[0]
    import datetime

    return sinks.purged(events, str(first + datetime.timedelta(days=2)))[0]


@query(with_tables("files", f", {_BM25.replace('FROM files)', 'FROM files WHERE language = ' + chr(39) + 'en' + chr(39) + ')', 1)} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20"))
def bm25_of_kind(s, d):
    return text.bm25(A.files(s, d).where("language = 'en'"), WORDS, 20).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC}, top AS (SELECT id, score FROM vec ORDER BY score DESC, id LIMIT 10) SELECT event_id, user_id, round(score, 6) AS score FROM top JOIN events ON event_id = id")
def session_search(s, d):
    top = vectors.nearest(_vectors(s, d), _query_vector(s, d), 10)
    return table(s, d, "events").join(top.withColumnRenamed("id", "event_id"), "event_id").select("event_id", "user_id", F.round("score", 6).alias("score"))


@query("WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label), c AS (SELECT vec_id AS id FROM embeddings WHERE label = 3) SELECT a, b, score FROM p WHERE score >= 0.36 AND (a IN (SELECT id FROM c) OR b IN (SELECT id FROM c)) ORDER BY score DESC, a, b LIMIT 30")
def clones_of_changed(s, d):
    stored = materialize(vectors.similar_pairs(_vectors(s, d), 0.355).withColumn("score", F.round("score", 6)), "similar")
    return symbols.clones_of(_vectors(s, d).where("owner = 3").select("id"), stored, 0.36, 30)
