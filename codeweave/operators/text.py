"""Text operators: tokens, BM25, grep, rule scans, snippets, chunk windows, HTML text and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.session import materialize


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscore of more than one byte."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: F.octet_length(t) > 1)


def lines(docs: DataFrame, text: str = "content") -> DataFrame:
    """Rows of docs with (line, content): 1-based number and text of each line; other columns stay."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(F.split(F.col(text), "\r?\n")).alias("at", text)).withColumn("line", F.col("at") + 1).drop("at")


def grep(docs: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """(path, line, content) of lines that match the regular expression, by path and line; documents without a match are not split."""
    found = lines(docs.select("path", "content").where(F.col("content").rlike(pattern))).where(F.col("content").rlike(pattern)).select("path", "line", "content")
    return found if limit is None else found.orderBy("path", "line").limit(limit)


def snippet(docs: DataFrame, first: int, last: int) -> DataFrame:
    """(id, snippet): lines first..last, clamped."""
    return docs.select("id", F.array_join(F.slice(F.split("content", "\r?\n"), max(1, first), max(0, last - max(1, first) + 1)), "\n").alias("snippet"))


def rule_scan(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """One finding a line and rule: (path, line, rule_id, severity, col, snippet).

    docs(path, extension, content), rules(rule_id, severity, extensions, pattern, exclude). A rule without extensions is for all
    files; matching ignores case; col is the 1-based byte offset of the first match; the snippet is trimmed to 120 characters. Rules are
    a table of some dozens, read at the driver; only documents that hold a pattern are split.
    """
    rules = rules.withColumn("pattern", F.lower("pattern")).withColumn("exclude", F.lower("exclude"))
    # The rules as one array: each line meets them in an expression, so a document is split once and no row is copied per rule.
    every = [r.asDict() for r in rules.select("rule_id", "severity", "extensions", "pattern", "exclude").collect()]
    if not every:
        return docs.select("path", F.lit(0).cast("long").alias("line"), F.lit("").alias("rule_id"), F.lit("").alias("severity"), F.lit(0).cast("long").alias("col"), F.lit("").alias("snippet")).where("false")
    low = F.lower(F.col("content"))
    own = lambda r: F.lit(True) if not r["extensions"] else F.col("extension").isin(r["extensions"])
    some = F.lit(False)
    for r in every:
        some = some | (own(r) & low.contains(r["pattern"]))
    rows = lines(docs.select("path", "extension", "content").where(some)).where(some)
    fits = lambda r: own(r) & low.contains(r["pattern"]) & (~low.contains(r["exclude"]) if r["exclude"] else F.lit(True))
    hits = F.filter(F.array(*(F.when(fits(r), F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), F.lit(r["pattern"]).alias("pattern"))) for r in every)), lambda x: x.isNotNull())
    met = rows.select("path", "line", "content", F.explode(hits).alias("hit"))
    col = F.expr("octet_length(substring_index(lower(content), hit.pattern, 1)) + 1")
    return met.select("path", F.col("line").cast("long").alias("line"), "hit.rule_id", "hit.severity", col.cast("long").alias("col"), F.substring(F.trim("content"), 1, 120).alias("snippet"))


def bm25(docs: DataFrame, query: str, k: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of docs(id, content) for a query; repeated query tokens count each time; only positive scores.

    The query's few terms are counted inside each document, so no posting of any other term is ever made.
    """
    spark: SparkSession = docs.sparkSession
    wanted = [r[0] for r in spark.range(1).select(F.explode(tokens(F.lit(query)))).collect()]
    terms = sorted(set(wanted))
    # Counted inside each document, by what is left of its tokens without a term.
    split = docs.select("id", F.split(F.lower("content"), r"[^\p{L}\p{N}_]+").alias("t"))
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    times = [(size("t") - size(F.array_remove("t", w))).cast("double").alias(f"tf{i}") for i, w in enumerate(terms)]
    counted = materialize(split.select("id", size(F.filter("t", lambda x: F.octet_length(x) > 1)).cast("double").alias("dl"), *times), "terms")
    stats = counted.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum(F.when(F.col(f"tf{i}") > 0, 1.0).otherwise(0.0)).alias(f"df{i}") for i in range(len(terms))))
    if not terms:
        return counted.where("false").select("id", F.lit(0.0).alias("score"))
    full = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))
    score = None
    for i, w in enumerate(terms):
        df, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        part = F.lit(float(wanted.count(w))) * F.log((F.col("n") - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0)) * tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
        score = part if score is None else score + part
    out = full.select("id", score.alias("score")).where("score > 0")
    return out if k is None else out.orderBy(F.desc("score"), "id").limit(k)


def word_windows(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(id, idx, words, text): windows of ``size`` words that overlap by ``overlap``; none starts after one that reached the end."""
    step = size - overlap
    w = docs.select("id", F.filter(F.split("content", r"\s+"), lambda x: x != "").alias("w"))
    count = F.lit(1) + F.ceil(F.greatest(F.lit(0), F.size("w") - size) / F.lit(float(step))).cast("int")
    rows = w.where("size(w) > 0").select("id", "w", F.explode(F.sequence(F.lit(0), count - 1)).alias("idx"))
    part = F.slice("w", F.col("idx") * step + 1, size)
    return rows.select("id", F.col("idx").cast("long").alias("idx"), F.size(part).cast("long").alias("words"), F.array_join(part, " ").alias("text"))


def html_text(html: Column) -> Column:
    """Text of HTML: tags become one space, white space collapses; script and style content and entities stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"<title>([^<]*)</title>", 1))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, link_type) of each anchor of pages(page_id, html) that isn't only a fragment."""
    url = F.explode(F.regexp_extract_all("html", F.lit("<a\\s[^>]*href=[\"']([^\"']+)[\"']"), F.lit(1)))
    found = pages.select("page_id", url.alias("url")).where("not startswith(url, '#')")
    kind = F.when(F.col("url").rlike("/wiki/|confluence|atlassian"), "confluence").when(F.col("url").rlike("/browse/|jira"), "jira").when(F.col("url").rlike("^(https?:)?//"), "external").otherwise("local")
    return found.withColumn("link_type", kind)


def normalised_route(path: Column) -> Column:
    """Route path: from /api/ on, without host and trailing slash, parameters as ``*``."""
    p = F.regexp_replace(path, "/+$", "")
    p = F.when(p.contains("/api/"), F.concat(F.lit("/api/"), F.regexp_replace(p, "^.*?/api/", ""))).when(p.rlike("^https?://"), F.regexp_replace(p, "^https?://[^/]*", "")).otherwise(p)
    return F.regexp_replace(p, "/[:{<][^/]*", "/*")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)([A-Z])", "_$1"))


def folders(paths: DataFrame) -> DataFrame:
    """(folder, parent, files): every prefix of path, its parent and how many files lie anywhere below it."""
    parts = paths.select(F.split("path", "/").alias("p")).where("size(p) > 1")
    each = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("n"))
    return each.select(F.array_join(F.slice("p", 1, F.col("n")), "/").alias("folder"), F.array_join(F.slice("p", 1, F.col("n") - 1), "/").alias("parent")).groupBy("folder", "parent").agg(F.count("*").alias("files"))
