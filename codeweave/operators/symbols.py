"""Lookups around symbols: files, references, contexts, inheritance by name, similar names, clusters, histories, reviews across repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweave.operators.graph import least_elsewhere, overlapping, pick_elsewhere
from codeweave.plans.joins import dealt_join, frequent, looked_up
from codeweave.session import materialize

# Kinds that can be inherited from, and the order in which changes are told.
TYPE_KINDS = ("Class", "Interface", "Struct", "Trait", "Enum")
CHANGE_ORDER = ("REMOVED", "SIGNATURE_CHANGED", "MODIFIED", "MOVED", "ADDED")


def in_file(symbols: DataFrame, file: str) -> DataFrame:
    """Symbols of a file by line."""
    return symbols.where(F.col("file") == file).orderBy("start_line", "id")


def api_surface(symbols: DataFrame, file: str | None = None) -> DataFrame:
    """Public symbols and routes, of the files whose path holds ``file`` if given, by file and line."""
    found = symbols.where("visibility = 'public' or kind = 'Route'")
    return (found if file is None else found.where(F.col("file").contains(file))).orderBy("file", "start_line", "id")


def references(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, caller, name, file, start_line): every place that refers to a symbol, parallel edges told once."""
    return edges.select(F.col("dst").alias("symbol"), F.col("src").alias("id")).distinct().join(symbols, "id").select("symbol", F.col("id").alias("caller"), "name", "file", "start_line")


def file_dependencies(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, direction, other, edges): for each file the files that it calls into (out) and that call into it (in), with distinct edges."""
    side = lambda x, f: symbols.select(F.col("id").alias(x), F.col("file").alias(f))
    pair = edges.select("src", "dst").distinct().join(side("src", "a"), "src").join(side("dst", "b"), "dst").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("edges"))
    return pair.select(F.col("a").alias("file"), F.lit("out").alias("direction"), F.col("b").alias("other"), "edges").unionAll(pair.select("b", F.lit("in"), "a", "edges"))


def context(symbols: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """(id, name, parent, docstring, callers, callees, n_callers, n_callees): a symbol and its neighbours, the ``most`` smallest ids of either side."""

    def side(mine: str, other: str, name: str) -> DataFrame:
        pair = edges.select(F.col(mine).alias("id"), F.col(other).alias("other")).distinct()
        ranked = pair.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("other"))).where(F.col("rank") <= most)
        listed = ranked.groupBy("id").agg(F.sort_array(F.collect_list("other")).alias(name))
        return pair.groupBy("id").agg(F.count("*").alias(f"n_{name}")).join(listed, "id")

    out = symbols.join(side("dst", "src", "callers"), "id", "left").join(side("src", "dst", "callees"), "id", "left")
    none = F.array().cast("array<string>")
    filled = [F.coalesce(F.col(c).cast("array<string>"), none).alias(c) for c in ("callers", "callees")]
    return out.select("id", "name", "parent", "docstring", *filled, *(F.coalesce(f"n_{c}", F.lit(0)).alias(f"n_{c}") for c in ("callers", "callees")))


def resolve_inherits(raw: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(src, dst) for raw(src, name, file): the type that a symbol inherits from by name, in another file; files(file): only raw rows of these.

    A name that the file itself has is left alone. Of the types of that name in other files, the only one; else the smallest in an
    imported file (imports(file, target_file)), else the smallest Interface, else the smallest.
    """
    raw = raw.select("src", "name", "file")
    if files is not None:
        raw = raw.join(files.select("file").distinct(), "file", "left_semi")
    local = symbols.select("file", "name").distinct()
    asked = materialize(raw.join(local, ["file", "name"], "left_anti").select(F.col("src").alias("call_id"), "name", "file"), "inherits")
    types = materialize(symbols.where(F.col("kind").isin(*TYPE_KINDS)).select("name", F.col("file").alias("target_file"), F.col("id").alias("target"), "kind"), "types")
    found = pick_elsewhere(asked, least_elsewhere(types, ["name"]), ["name"]).withColumn("rank", F.lit(3))
    found = found.unionByName(pick_elsewhere(asked, least_elsewhere(types.where("kind = 'Interface'"), ["name"]), ["name"]).withColumn("rank", F.lit(2)))
    if imports is not None:
        known = imports.select("file", "target_file").where("file <> target_file").distinct()
        wanted = materialize(asked.select("name", "file").distinct(), "wanted")
        near = dealt_join(wanted, known, ["file"]).join(types, ["name", "target_file"]).groupBy("name", "file").agg(F.min("target").alias("target"))
        found = found.unionByName(looked_up(asked, near, ["name", "file"], frequent(asked, ["name", "file"])).where("target is not null").select("call_id", "target").withColumn("rank", F.lit(1)))
    # A single type is the smallest, the smallest Interface or the smallest imported one at once, so it needs no rank of its own.
    best = found.groupBy("call_id").agg(F.min(F.struct("rank", "target")).alias("best"))
    return best.select(F.col("call_id").alias("src"), F.col("best.target").alias("dst"))


def similar_names(symbols: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    """(probe, id): for each of probes(probe, file) the k smallest symbols of other files whose name holds it without being it.

    Names are compared once each, not once a symbol.
    """
    names = symbols.select("name").distinct()
    met = names.join(F.broadcast(probes.select("probe").distinct()), F.col("name").contains(F.col("probe")) & (F.col("name") != F.col("probe")))
    found = symbols.select("id", "name", "file").join(met, "name").join(probes.select("probe", F.col("file").alias("own")), "probe").where("file <> own")
    ranked = found.select("probe", "id").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy("id")))
    return ranked.where(F.col("rank") <= k).select("probe", "id")


def clones_of(changed: DataFrame, similar: DataFrame, least: float = 0.9, k: int = 30) -> DataFrame:
    """The k strongest stored pairs similar(a, b, score) from ``least`` on with an end in changed(id)."""
    ids = changed.select("id").distinct()
    hit = similar.where(F.col("score") >= least)
    hit = hit.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").unionByName(hit.join(ids.withColumnRenamed("id", "b"), "b", "left_semi")).distinct()
    return hit.orderBy(F.desc("score"), "a", "b").limit(k)


def clusters(members: DataFrame, first: int = 5) -> DataFrame:
    """(cluster, size, description): members(cluster, id, file) counted, with the ``first`` smallest of their files."""
    files = members.select("cluster", "file").distinct()
    ranked = files.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("file"))).where(F.col("rank") <= first)
    told = ranked.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("file")), ", ").alias("description"))
    return members.groupBy("cluster").agg(F.count_distinct("id").alias("size")).join(told, "cluster")


def previews(rows: DataFrame, group: str, column: str, n: int = 3) -> DataFrame:
    """(group, n, names): how many rows a group has and its first ``n`` distinct values of the column."""
    ranked = rows.select(group, column).distinct().withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(column))).where(F.col("rank") <= n)
    listed = ranked.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(column)), ", ").alias("names"))
    return rows.groupBy(group).agg(F.count("*").alias("n")).join(listed, group)


def ordered_changes(diff: DataFrame, k: int | None = None) -> DataFrame:
    """Changes as they are told: removed, changed, moved, added; then by file, name and kind."""
    rank = F.array_position(F.lit(list(CHANGE_ORDER)), F.col("change"))
    out = diff.orderBy(rank, "file", "name", "kind")
    return out if k is None else out.limit(k)


def commit_symbols(commits: DataFrame, hunks: DataFrame, symbols: DataFrame, author: str | None = None, file: str | None = None, ids_a_row: int = 1 << 16) -> DataFrame:
    """(commit, author, id): symbols whose lines a commit touched; commits(commit, author), hunks(commit, file, start_line, end_line).

    Commits that may touch over ``ids_a_row`` symbols (lines touched times the longest list of symbols) get no list of their own.
    """
    if author is not None:
        commits = commits.where(F.col("author").contains(author))
    if file is not None:
        hunks = hunks.where(F.col("file").contains(file))
    keys = ["file", "low", "high"]
    ranges = hunks.join(commits.select("commit", "author"), "commit").select("commit", "author", "file", F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    ranges = materialize(ranges.distinct(), "ranges")
    # Lines that many commits touched meet the symbols once, and commits take the list of these.
    touched = overlapping(symbols.select("file", "id", "start_line", "end_line"), ranges.select(*keys).distinct()).groupBy(*keys)
    touched = materialize(touched.agg(F.collect_set("id").alias("ids"), F.max(F.col("id").isNull()).alias("nameless")), "touched")
    every = lambda r: dealt_join(r, touched, keys).select("commit", "author", "ids", "nameless")
    told = lambda d: d.select("commit", "author", F.explode(F.when(F.col("nameless"), F.array_append("ids", F.lit(None))).otherwise(F.col("ids"))).alias("id"))
    most = touched.agg(F.max(F.size("ids"))).first()[0] or 0
    large = materialize(ranges.groupBy("commit", "author").agg(F.count("*").alias("n")).where(F.col("n") * most > ids_a_row).select("commit", "author"), "large")
    if not large.limit(1).count():
        return told(_joined_ids(every(ranges)))
    same = F.col("commit").eqNullSafe(F.col("_commit")) & F.col("author").eqNullSafe(F.col("_author"))
    large = large.toDF("_commit", "_author")
    pick = lambda how: materialize(ranges.join(large, same, how), "ranges")
    return told(_joined_ids(every(pick("left_anti")))).unionByName(told(every(pick("left_semi"))).distinct())


def _joined_ids(hits: DataFrame) -> DataFrame:
    """hits(commit, author, ids, nameless) with one row a commit and each id once; only the lists are shuffled."""
    lists = hits.repartition("commit").groupBy("commit", "author").agg(F.collect_list("ids").alias("ids"), F.max("nameless").alias("nameless"))
    return lists.withColumn("ids", F.array_distinct(F.flatten("ids")))


def repo_callers(changed: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, repo, other, callers): for each changed(id) symbol of a repository how many symbols of each other one call it."""
    own = symbols.select("id", "repo").join(changed.select("id").distinct(), "id", "left_semi")
    far = symbols.select(F.col("id").alias("src"), F.col("repo").alias("other"))
    hit = edges.select("src", F.col("dst").alias("id")).distinct().join(own, "id").join(far, "src").where("repo <> other")
    return hit.groupBy("id", "repo", "other").agg(F.count("*").alias("callers"))


def uneven(changed: DataFrame, least: int = 3) -> DataFrame:
    """(name, id, kind, usual): changed(id, name, kind, repo) whose kind of change isn't the one that the first repository gave the name.

    Only names that changed in ``least`` repositories or more.
    """
    some = changed.groupBy("name").agg(F.count_distinct("repo").alias("repos"), F.min(F.struct("repo", "id", "kind")).getField("kind").alias("usual")).where(F.col("repos") >= least)
    return changed.join(some, "name").where("kind <> usual").select("name", "id", "kind", "usual")


def promoted(bridges: DataFrame, calls: DataFrame) -> DataFrame:
    """Bridge edges (src, dst) that aren't calls yet."""
    return bridges.select("src", "dst").distinct().join(calls.select("src", "dst"), ["src", "dst"], "left_anti")


def manifest_edges(modules: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(module, dependency): modules(id, path) whose path ends in the file name of the manifest that names dependencies(id, manifest)."""
    base = lambda c: F.substring_index(c, "/", -1)
    left = modules.select(F.col("id").alias("module"), base("path").alias("base"))
    right = dependencies.select(F.col("id").alias("dependency"), base("manifest").alias("base"))
    return left.join(right, "base").select("module", "dependency").distinct()


def probed_language(files: DataFrame, probes: list[tuple[str, str, str]]) -> DataFrame:
    """files(path, extension, content, language) with the language of the first probe (extension, pattern, language) that fits."""
    out = F
    for extension, pattern, language in probes:
        out = out.when((F.col("extension") == extension) & F.col("content").rlike(pattern), language)
    return files.withColumn("language", out.otherwise(F.col("language")))


def kept_first(symbols: DataFrame) -> DataFrame:
    """One row an id of symbols(id, kind, at, ...): a Test if there is one, else the first."""
    order = Window.partitionBy("id").orderBy(F.when(F.col("kind") == "Test", 0).otherwise(1), "at")
    return symbols.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
