"""Instances of the code-graph tables on the driver's tables, each with its SQL twin (a common table expression)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CALLS edges (src, dst): consecutive parts of an order, with multiplicity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *_ORDER)
    before = F.lag("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    return lines.select(before.alias("src"), F.col("l_partkey").alias("dst")).where("src is not null")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols (id, name, kind, file, complexity, price) from parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file"), F.col("p_size").alias("complexity"))


def inherits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INHERITS edges (src child, dst parent): customers and suppliers of nations of regions."""
    edge = lambda name, a, x, b, y: table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"))
    return edge("customer", "c:", "c_custkey", "n:", "c_nationkey").unionAll(edge("supplier", "s:", "s_suppkey", "n:", "s_nationkey")).unionAll(edge("nation", "n:", "n_nationkey", "r:", "n_regionkey"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (id, name, kind, file, complexity) at the ends of the INHERITS edges: customers, suppliers, nations and regions."""
    node = lambda name, a, x, title, kind, file, size: table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(x)).alias("id"), F.col(title).alias("name"), kind.alias("kind"), file.cast("string").alias("file"), size.cast("int").alias("complexity"))
    out = node("customer", "c:", "c_custkey", "c_name", F.col("c_mktsegment"), F.col("c_nationkey"), F.floor(F.abs("c_acctbal") / 100))
    out = out.unionAll(node("supplier", "s:", "s_suppkey", "s_name", F.lit("Supplier"), F.col("s_nationkey"), F.floor(F.abs("s_acctbal") / 100)))
    out = out.unionAll(node("nation", "n:", "n_nationkey", "n_name", F.lit("Nation"), F.col("n_regionkey"), F.lit(1)))
    return out.unionAll(node("region", "r:", "r_regionkey", "r_name", F.lit("Region"), F.lit("world"), F.lit(1)))


def tested_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TESTED_BY edges (src symbol, dst test): returned parts and their suppliers."""
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (id, path, extension, repo, language, content, content_hash) from documents; the extension goes by the language."""
    extension = F.expr("case lang when 'en' then 'py' when 'de' then 'js' when 'fr' then 'java' else 'go' end")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("", "source", F.lit("/"), "doc_id", F.lit("."), extension).alias("path"), extension.alias("extension"), F.col("source").alias("repo"), F.col("lang").alias("language"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals (file, id, start_line, end_line): the span of line numbers of each part within an order's customer file."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("id")).agg(F.min("l_linenumber").alias("start_line"), F.max("l_linenumber").alias("end_line"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of symbols (file, name, kind, hash) from documents: the old one has no Spanish and the new one no French ones, those
    of one source have moved, and those with the word "and" have changed."""
    docs = table(spark, sf_dir, "documents")
    cut = lambda d, moved, text: d.select(moved.alias("file"), F.concat(F.lit("f"), F.col("doc_id")).alias("name"), F.col("lang").alias("kind"), F.substring(F.sha2(text, 256), 1, 16).alias("hash"))
    old = cut(docs.where("lang <> 'es'"), F.col("source"), F.col("text"))
    new = cut(docs.where("lang <> 'fr'"), F.when(F.col("source") == "src8", "src8_new").otherwise(F.col("source")), F.when(F.col("text").contains(" and "), F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text")))
    return old, new


_LAG = "lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS src, l_partkey AS dst"
SQL = {
    "calls": f"calls AS (SELECT src, dst FROM (SELECT {_LAG} FROM lineitem) WHERE src IS NOT NULL)",
    "symbols": "symbols AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS file, p_size AS complexity FROM part)",
    "inherits": "inherits AS (SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation)",
    "people": "people AS (SELECT 'c:' || c_custkey AS id, c_name AS name, c_mktsegment AS kind, CAST(c_nationkey AS VARCHAR) AS file, CAST(floor(abs(c_acctbal) / 100) AS INTEGER) AS complexity FROM customer UNION ALL SELECT 's:' || s_suppkey, s_name, 'Supplier', CAST(s_nationkey AS VARCHAR), CAST(floor(abs(s_acctbal) / 100) AS INTEGER) FROM supplier UNION ALL SELECT 'n:' || n_nationkey, n_name, 'Nation', CAST(n_regionkey AS VARCHAR), 1 FROM nation UNION ALL SELECT 'r:' || r_regionkey, r_name, 'Region', 'world', 1 FROM region)",
    "tested_by": "tested_by AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'R')",
    "files": "files AS (SELECT doc_id AS id, source || '/' || doc_id || '.' || e AS path, e AS extension, source AS repo, lang AS language, text AS content, sha256(text) AS content_hash FROM (SELECT *, CASE lang WHEN 'en' THEN 'py' WHEN 'de' THEN 'js' WHEN 'fr' THEN 'java' ELSE 'go' END AS e FROM documents))",
    "spans": "spans AS (SELECT l_suppkey AS file, l_partkey AS id, min(l_linenumber) AS start_line, max(l_linenumber) AS end_line FROM lineitem GROUP BY ALL)",
    "snapshots": """old AS (SELECT source AS file, 'f' || doc_id AS name, lang AS kind, substr(sha256(text), 1, 16) AS hash FROM documents WHERE lang <> 'es'),
new AS (SELECT CASE WHEN source = 'src8' THEN 'src8_new' ELSE source END AS file, 'f' || doc_id AS name, lang AS kind, substr(sha256(CASE WHEN contains(text, ' and ') THEN text || '!' ELSE text END), 1, 16) AS hash FROM documents WHERE lang <> 'fr')""",
}


def with_tables(names: str, query: str) -> str:
    """The query below the named common table expressions."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names.split()) + "\n" + query


_KINDS = "case p_type when 'STANDARD' then 'Function' when 'ECONOMY' then 'Method' when 'MEDIUM' then 'Class' when 'PROMO' then 'Interface' when 'LARGE' then 'Route' else 'Test' end"
_NAMES = "case p_type when 'ECONOMY' then 'create_' when 'STANDARD' then 'get_' when 'SMALL' then 'test_' else '' end || replace(p_name, ' ', '_') || case when p_type = 'LARGE' then '_handler' else '' end"
_UNIT = f"p_partkey AS id, {_NAMES} AS name, {_KINDS} AS kind, p_brand AS file, p_size AS start_line, CAST(p_size + floor((p_retailprice - 900) / 10) AS INTEGER) AS end_line, p_size AS complexity, CASE WHEN p_retailprice >= 980 THEN 'public' ELSE '' END AS visibility, p_name || ' of ' || p_brand AS docstring, p_brand || '::' || p_type AS parent"
SQL["units"] = f"units AS (SELECT {_UNIT} FROM part)"
SQL["code"] = """code AS (SELECT id, path, extension, language, content || chr(10) || CASE extension
  WHEN 'py' THEN 'lib = ctypes.CDLL("lib' || id || '.so")' || chr(10) || 'api_key = "k' || id || '"'
  WHEN 'js' THEN 'WebAssembly.instantiate(buffer' || id || ', {})' || chr(10) || 'eval(text)'
  WHEN 'java' THEN '  System.loadLibrary("core' || id || '");'
  ELSE 'import "C"' || chr(10) || 'x := C.call_' || id || '(1)' END AS content FROM files)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols (id, name, kind, file, start_line, end_line, complexity, visibility, docstring, parent) from parts, named by their kind."""
    return table(spark, sf_dir, "part").selectExpr(*_split(_UNIT))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (id, path, extension, language, content) with two lines of code below each document, by its extension."""
    line = F.expr("""case extension
      when 'py' then concat('lib = ctypes.CDLL("lib', id, '.so")\\napi_key = "k', id, '"')
      when 'js' then concat('WebAssembly.instantiate(buffer', id, ', {})\\neval(text)')
      when 'java' then concat('  System.loadLibrary("core', id, '");')
      else concat('import "C"\\nx := C.call_', id, '(1)') end""")
    return files(spark, sf_dir).select("id", "path", "extension", "language", F.concat("content", F.lit("\n"), line).alias("content"))


def _split(columns: str) -> list[str]:
    """Top-level parts of a comma-separated list."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]
