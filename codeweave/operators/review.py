"""Recommendations, gates and review reports over symbols and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.functions.scalars import is_test

_IMPACT = "case impact when 'High' then 3 when 'Medium' then 2 else 1 end"
_EFFORT = "case effort when 'High' then 1 when 'Medium' then 2 else 3 end"


def _level(*pairs: tuple[Column, str], other: str) -> Column:
    out = None
    for condition, name in pairs:
        out = (F.when if out is None else out.when)(condition, name)
    return out.otherwise(other)


def size_recommendations(symbols: DataFrame) -> DataFrame:
    """Files of more than 1000 lines or 40 symbols."""
    rows = symbols.groupBy("file").agg(F.count("*").alias("n"), F.max("end_line").alias("last")).where("last > 1000 or n > 40")
    return rows.select(F.lit("split_file").alias("kind"), F.col("file").alias("target"), _level(((F.col("last") > 2000) | (F.col("n") > 80), "High"), other="Medium").alias("impact"), _level((F.col("n") > 60, "High"), other="Medium").alias("effort"))


def complexity_recommendations(symbols: DataFrame) -> DataFrame:
    """The ten most complex symbols of at least 15."""
    rows = symbols.where("complexity >= 15").orderBy(F.desc("complexity"), "id").limit(10)
    c = F.col("complexity")
    return rows.select(_level((F.col("end_line") - F.col("start_line") > 80, "extract_function"), other="simplify_logic").alias("kind"), F.col("id").alias("target"), _level((c > 20, "High"), other="Medium").alias("impact"), _level((c > 30, "High"), other="Medium").alias("effort"))


def coupling_recommendations(edges: DataFrame) -> DataFrame:
    """Among the 20 largest: nodes that call at least 15 others, and nodes that at least 20 others call."""
    side = lambda a, b: edges.groupBy(F.col(a).alias("target")).agg(F.count_distinct(b).alias("n")).orderBy(F.desc("n"), "target").limit(20)
    out = side("src", "dst").where("n >= 15").select(F.lit("reduce_fan_out").alias("kind"), F.col("target").cast("string").alias("target"), _level((F.col("n") > 25, "High"), other="Medium").alias("impact"), F.lit("Medium").alias("effort"))
    into = side("dst", "src").where("n >= 20").select(F.lit("reduce_fan_in").alias("kind"), F.col("target").cast("string").alias("target"), F.lit("High").alias("impact"), F.lit("High").alias("effort"))
    return out.unionByName(into)


def dead_code_recommendations(dead: DataFrame) -> DataFrame:
    """Dead symbols (id, name, file): one row a file with three or more, with its first five names, else one a symbol."""
    grouped = dead.groupBy("file").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("name")), 1, 5).alias("names"))
    many = grouped.where("n >= 3").select(F.lit("remove_dead_code").alias("kind"), F.concat(F.col("file"), F.lit(": "), F.array_join("names", ", ")).alias("target"))
    few = dead.join(grouped.where("n < 3").select("file"), "file", "left_semi").select(F.lit("remove_dead_code").alias("kind"), F.col("id").cast("string").alias("target"))
    return many.unionByName(few).withColumn("impact", F.lit("Low")).withColumn("effort", F.lit("Low"))


def prioritised(recommendations: DataFrame, k: int) -> DataFrame:
    """The k recommendations of the highest impact times ease."""
    return recommendations.withColumn("priority", F.expr(f"({_IMPACT}) * ({_EFFORT})")).orderBy(F.desc("priority"), "kind", "target").limit(k)


def gates(findings: DataFrame, dead: DataFrame, coverage_percent: DataFrame, max_critical: int = 0, max_high: int = 0, max_dead: int = 0, least_coverage: int = 0) -> DataFrame:
    """(check, value, passed), a row each for security, dead code and coverage."""
    counts = findings.agg(F.count(F.when(F.col("severity") == "Critical", 1)).alias("c"), F.count(F.when(F.col("severity") == "High", 1)).alias("h"))
    security = counts.select(F.lit("security").alias("check"), (F.col("c") + F.col("h")).cast("double").alias("value"), ((F.col("c") <= max_critical) & (F.col("h") <= max_high)).alias("passed"))
    unused = dead.agg(F.count("*").alias("n")).select(F.lit("dead_code").alias("check"), F.col("n").cast("double").alias("value"), (F.col("n") <= max_dead).alias("passed"))
    covered = coverage_percent.agg(F.max("percent").alias("p")).select(F.lit("coverage").alias("check"), F.col("p").cast("double").alias("value"), (F.col("p") >= least_coverage).alias("passed"))
    return security.unionAll(unused).unionAll(covered)


def impact_of_hunks(symbols: DataFrame, edges: DataFrame, hunks: DataFrame, depth: int = 3) -> DataFrame:
    """(id, impact): symbols that overlap a hunk are direct, those that reach them by calls within ``depth`` indirect."""
    from codeweave.operators.graph import overlapping, reach

    ranges = hunks.select("file", F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    direct = overlapping(symbols.select("file", "id", "start_line", "end_line"), ranges).select("id").distinct()
    indirect = reach(edges, direct, depth, reverse=True).select("id").join(direct, "id", "left_anti")
    return direct.withColumn("impact", F.lit("direct")).unionByName(indirect.withColumn("impact", F.lit("indirect")))


def review(diff: DataFrame, symbols: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of a change: counts by kind of change, changed symbols without a test, callers outside, findings in changed files."""
    changed = diff.where("change <> 'REMOVED'").select("file", "name").distinct()
    touched = symbols.join(changed, ["file", "name"], "left_semi")
    tests = symbols.where(is_test(F.col("name"), F.col("kind"), F.col("file"))).select(F.col("id").alias("src"))
    tested = edges.join(tests, "src", "left_semi").select(F.col("dst").alias("id"))
    outside = edges.join(touched.select(F.col("id").alias("dst")), "dst", "left_semi").join(touched.select(F.col("id").alias("src")), "src", "left_anti")
    count = lambda d, name: d.agg(F.count("*").alias(name))
    out = diff.groupBy().pivot("change", ["ADDED", "REMOVED", "MOVED", "SIGNATURE_CHANGED"]).count().na.fill(0)
    out = out.crossJoin(count(touched.where(~is_test(F.col("name"), F.col("kind"), F.col("file"))).join(tested, "id", "left_anti"), "untested"))
    out = out.crossJoin(count(outside.select("src").distinct(), "outside_callers"))
    return out.crossJoin(count(findings.join(changed.select("file").distinct().withColumnRenamed("file", "path"), "path", "left_semi"), "findings"))


SECTIONS = ("changed", "blast_radius", "affected_tests", "api_surface", "security", "complexity", "dead_code", "clones", "consistency")


def report(diff: DataFrame, symbols: DataFrame, edges: DataFrame, findings: DataFrame, similar: DataFrame | None = None, callers: DataFrame | None = None, limit: int = 100, complex_from: int = 10) -> DataFrame:
    """(section, file, name, detail): the sections of a change's review, a row an entry.

    diff(file, name, kind, change); symbols(id, name, kind, file, visibility, complexity); edges(src, dst); findings(path, line, rule_id,
    severity); similar(a, b, score), callers(name, id, value, median) as ``changes.outliers`` gives them. The blast radius is all that
    reaches a changed symbol by calls, cut to ``limit`` by file and name; tests are looked for in what is left.
    """
    from codeweave.operators.graph import dead_code, reach
    from codeweave.operators.symbols import clones_of
    from codeweave.session import materialize

    section = lambda df, name, detail: df.select(F.lit(name).alias("section"), "file", "name", detail.cast("string").alias("detail"))
    keys, files = diff.select("file", "name", "kind").distinct(), diff.select("file").distinct()
    touched = symbols.join(keys, ["file", "name", "kind"], "left_semi")
    near = symbols.join(files, "file", "left_semi")
    far = reach(edges, touched.select("id"), None, reverse=True).select("id")
    blast = materialize(symbols.join(far, "id", "left_semi").orderBy("file", "name", "id").limit(limit), "blast")
    parts = [
        section(diff, "changed", F.col("change")),
        section(blast, "blast_radius", F.col("kind")),
        section(blast.where(is_test(F.col("name"), F.col("kind"), F.col("file"))), "affected_tests", F.col("kind")),
        section(touched.where("visibility = 'public' or kind = 'Route'"), "api_surface", F.col("kind")),
        section(findings.withColumnRenamed("path", "file").join(files, "file", "left_semi").withColumn("name", F.col("rule_id")), "security", F.concat_ws(":", "severity", "line")),
        section(near.where(F.col("complexity") >= complex_from), "complexity", F.col("complexity")),
        section(dead_code(edges, near, ["Function", "Method"]), "dead_code", F.col("kind")),
    ]
    if similar is not None:
        names = symbols.select("id", "name", "file")
        pairs = clones_of(near.select("id"), similar).join(names.withColumnRenamed("id", "a"), "a").join(names.select(F.col("id").alias("b"), F.col("name").alias("other")), "b")
        parts.append(section(pairs, "clones", F.concat_ws(":", "other", "score")))
    if callers is not None:
        odd = callers.join(touched.select("id", "file"), "id")
        parts.append(section(odd, "consistency", F.concat_ws(" of ", "value", "median")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
