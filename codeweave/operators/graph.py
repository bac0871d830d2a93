"""Graph operators over edge tables (src, dst) and node tables (id, ...): set-at-a-time joins, never a walk at the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweave.plans.joins import FREQUENT_KEYS, dealt_join, frequent, looked_up
from codeweave.session import discard, materialize


def callers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that call others, with the distinct callee: (callee, id, name, file)."""
    return edges.distinct().join(nodes, edges["src"] == nodes["id"]).select(F.col("dst").alias("callee"), "id", "name", "file")


def callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that are called, with the distinct caller: (caller, id, name, file)."""
    return edges.distinct().join(nodes, edges["dst"] == nodes["id"]).select(F.col("src").alias("caller"), "id", "name", "file")


def hubs(edges: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """The k most called nodes, parallel edges counted: (id, name, calls)."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("calls")).join(nodes.select("id", "name"), "id").orderBy(F.desc("calls"), "id").limit(k).select("id", "name", "calls")


def entry_points(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that call and are never called."""
    out = edges.select(F.col("src").alias("id")).distinct()
    return nodes.join(out, "id", "left_semi").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def dead_code(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None, live_names: list[str] | None = None, live_files: DataFrame | None = None) -> DataFrame:
    """Nodes of the kinds without an incoming edge, but for live names (patterns may end in ``*``) and files with live types."""
    found = nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
    if kinds is not None:
        found = found.where(F.col("kind").isin(kinds))
    for name in live_names or []:
        found = found.where(~F.col("name").startswith(name[:-1]) if name.endswith("*") else F.col("name") != name)
    return found if live_files is None else found.join(live_files, "file", "left_anti")


def degree(edges: DataFrame, side: str, least: int, k: int = 20) -> DataFrame:
    """Distinct neighbours per node on one side, from ``least`` on, the k largest: (id, degree)."""
    other = "dst" if side == "src" else "src"
    return edges.groupBy(F.col(side).alias("id")).agg(F.count_distinct(other).alias("degree")).where(F.col("degree") >= least).orderBy(F.desc("degree"), "id").limit(k)


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(id, level): nodes reachable from seeds(id) in 1..depth hops with their least distance; a seed only through a cycle.

    One join a level against nodes not seen before. Each level is written once, so lineage stays short; without a depth the
    loop ends when a level is empty.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = materialize(edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct(), "steps")
    frontier, seen, level = seeds.select("id").distinct(), None, 0
    while depth is None or level < depth:
        level += 1
        new = step.join(frontier, "id", "left_semi").select(F.col("next").alias("id")).distinct()
        if seen is not None:
            new = new.join(seen, "id", "left_anti")
        new = materialize(new.withColumn("level", F.lit(level)), "frontier")
        if not new.limit(1).count():
            break
        seen = new if seen is None else seen.unionAll(new)
        frontier = new.select("id")
    return seen if seen is not None else seeds.select("id").where("false").withColumn("level", F.lit(0))


def hierarchy(inherits: DataFrame, way: str, depth: int | None = None) -> DataFrame:
    """(id, other, level): every ancestor (way ``up``) or descendant (``down``) of every type, with its least distance, to any depth."""
    a, b = ("src", "dst") if way == "up" else ("dst", "src")
    step = materialize(inherits.select(F.col(a).alias("other"), F.col(b).alias("next")).distinct(), "steps")
    now = materialize(step.select(F.col("other").alias("id"), F.col("next").alias("other"), F.lit(1).alias("level")), "hierarchy")
    found, level = now, 1
    while now.limit(1).count() and (depth is None or level < depth):
        level += 1
        new = dealt_join(now.select("id", "other"), step, ["other"]).select("id", F.col("next").alias("other")).distinct()
        now = materialize(new.join(found, ["id", "other"], "left_anti").withColumn("level", F.lit(level)), "hierarchy")
        found = found.unionByName(now)
    return found


def bfs_edges(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(level, src, dst): distinct edges that leave the nodes of each level of a forward search."""
    step = materialize(edges.distinct(), "steps")
    nodes = seeds.select("id").distinct().withColumn("level", F.lit(0)).unionByName(reach(step, seeds, depth - 1))
    nodes = nodes.groupBy("id").agg(F.min("level").alias("level"))
    return step.join(nodes, step["src"] == nodes["id"]).select((F.col("level") + 1).alias("level"), "src", "dst")


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Distinct edges among the nodes within ``hops`` of the seeds, edges taken both ways."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = reach(both, seeds, hops).select("id").unionByName(seeds.select("id")).distinct()
    ends = edges.distinct().join(near.withColumnRenamed("id", "src"), "src", "left_semi")
    return ends.join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def cross_file(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, other): files whose symbols call into or are called from another file, both directions, distinct."""
    ends = edges.distinct().join(nodes.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst").where("a <> b").select("a", "b")
    return ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().select(F.col("a").alias("file"), F.col("b").alias("other"))


def overlapping(intervals: DataFrame, ranges: DataFrame) -> DataFrame:
    """Intervals (file, id, start_line, end_line) that overlap ranges (file, low, high): equality on file, a residual range test."""
    hit = (F.col("start_line") <= F.col("high")) & (F.col("end_line") >= F.col("low"))
    return intervals.join(ranges, "file").where(hit)


def innermost(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """(file, line, id): the shortest interval that contains each point (file, line); ties to the smallest id."""
    inside = points.join(intervals, "file").where("start_line <= line and line <= end_line")
    return inside.groupBy("file", "line").agg(F.min(F.struct(F.expr("end_line - start_line"), "id")).getField("id").alias("id"))


def implementations(inherits: DataFrame, least: int = 3, sure: int = 5) -> DataFrame:
    """(parent, implementations, confidence): parents with at least ``least`` children."""
    return inherits.groupBy(F.col("dst").alias("parent")).agg(F.count_distinct("src").alias("implementations")).where(F.col("implementations") >= least).withColumn("confidence", F.when(F.col("implementations") >= sure, "high").otherwise("medium"))


def resolve(raw: DataFrame, candidates: DataFrame, imports: DataFrame | None = None, learned: DataFrame | None = None) -> DataFrame:
    """Each raw call (call_id, name, file, receiver) with the candidate that the best-ranked strategy gives.

    candidates(id, name, file, kind, parent). Ranks: 0 learned(file, name, target), 1 parent equals the receiver, 2 the only
    candidate, 3 the id holds the receiver, 4 the candidate's file is imported (imports(file, target_file)). Candidates of the
    same file don't count; without a rank a call stays unresolved (no row). Ties to the smallest id.

    A call never meets all candidates of its name: these are first summed up by name, by (name, parent) and by (name, file), each
    with its two smallest ids in different files, and a call looks its answers up by these keys.
    """
    raw = materialize(raw.select("call_id", "name", "file", "receiver"), "raw")
    c = materialize(candidates.select(F.col("id").alias("target"), "name", F.col("file").alias("target_file"), F.col("parent").alias("target_parent")), "candidates")
    found = []
    # The smallest candidate of a key in any other file: its smallest id overall, or the smallest outside that one's file.
    by_file = c.groupBy("name", "target_file").agg(F.count("*").alias("n"), F.min("target").alias("least"))
    unique = by_file.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("files"))
    own = looked_up(raw, unique, ["name"], frequent(raw, ["name"]))
    here = by_file.select("name", F.col("target_file").alias("file"), F.col("n").alias("own"))
    own = looked_up(own.where("n is not null"), here, ["name", "file"], frequent(raw, ["name", "file"]))
    alone = own.where("n - coalesce(own, 0) = 1").select("call_id", "name", "file")
    one = least_elsewhere(c, ["name"])
    found.append(pick_elsewhere(alone, one, ["name"]).withColumn("rank", F.lit(2)))
    named = raw.where("receiver <> ''").withColumn("target_parent", F.col("receiver"))
    found.append(pick_elsewhere(materialize(named, "named"), least_elsewhere(c.where("target_parent is not null"), ["name", "target_parent"]), ["name", "target_parent"]).withColumn("rank", F.lit(1)))
    # Receivers are few beside calls: each (name, receiver) tests its name's candidates once.
    asked = raw.where("receiver <> ''").select("name", "receiver").distinct()
    holds = dealt_join(c, asked, ["name"]).where(F.col("target").cast("string").contains(F.col("receiver")))
    found.append(pick_elsewhere(raw.where("receiver <> ''"), least_elsewhere(holds, ["name", "receiver"]), ["name", "receiver"]).withColumn("rank", F.lit(3)))
    if imports is not None:
        known = materialize(imports.select("file", "target_file").where("file <> target_file").distinct(), "imports")
        asked = materialize(raw.select("name", "file").distinct(), "asked")
        near = dealt_join(asked, known, ["file"]).join(by_file.select("name", "target_file", "least"), ["name", "target_file"])
        near = near.groupBy("name", "file").agg(F.min("least").alias("target"))
        found.append(looked_up(raw, near, ["name", "file"], frequent(raw, ["name", "file"])).where("target is not null").select("call_id", "target").withColumn("rank", F.lit(4)))
    if learned is not None:
        found.append(raw.join(learned, ["file", "name"]).select("call_id", F.col("target"), F.lit(0).alias("rank")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.groupBy("call_id").agg(F.min(F.struct("rank", "target")).alias("best"))
    return best.select("call_id", "best.target", "best.rank")


def least_elsewhere(c: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, first, first_file, second): the smallest target of each key, its file, and the smallest target of the other files."""
    files = materialize(c.groupBy(*keys, "target_file").agg(F.min("target").alias("target")), "files")
    first = files.groupBy(*keys).agg(F.min(F.struct("target", "target_file")).alias("first"))
    told = looked_up(files, first, keys, frequent(files, keys))
    return told.groupBy(*keys).agg(F.first("first.target").alias("first"), F.first("first.target_file").alias("first_file"), F.min(F.when(F.col("target_file") != F.col("first.target_file"), F.col("target"))).alias("second"))


def pick_elsewhere(calls: DataFrame, least: DataFrame, keys: list[str]) -> DataFrame:
    """(call_id, target): for each call(call_id, file, *keys) the smallest target of its key that lies in another file, if any."""
    calls = materialize(calls.select("call_id", "file", *keys), "asked")
    told = looked_up(calls, least, keys, frequent(calls, keys))
    return told.select("call_id", F.when(F.col("first_file") != F.col("file"), F.col("first")).otherwise(F.col("second")).alias("target")).where("target is not null")


def louvain(edges: DataFrame, nodes: DataFrame, sweeps: int = 20, parts: int = 4) -> DataFrame:
    """(id, community): one level of modularity moves, as synchronous rounds of joins.

    Weights count parallel and antiparallel edges; loops don't count. In each round a node joins the neighbouring community with the
    largest gain if that is positive. A sweep is ``parts`` rounds, each for the nodes of one part by hash, so that moves see most of the
    others'; of two single nodes only the larger id moves. It ends when no part moved twice in turn. Ties to the smallest community;
    a community is named by its smallest member at the end.
    """
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    both = materialize(pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "weights", bucket_by="b")
    total = both.agg(F.sum("w")).first()[0] or 0.0
    place = nodes.select(F.col("id").alias("a"), F.col("id").alias("community")).distinct()
    if not total:
        return place.select(F.col("a").alias("id"), "community")
    # Nodes without edges have no degree and stay alone.
    place = materialize(place.join(both.groupBy(F.col("b").alias("a")).agg(F.sum("w").alias("k")), "a", "left"), "place")
    quiet = 0
    for turn in range(sweeps * parts):
        size = place.where("k is not null").groupBy("community").agg(F.sum("k").alias("tot"), F.count("*").alias("members"))
        size = materialize(size, "sizes")
        told = place.where("k is not null").join(size, "community").select("a", "community", "k", "tot", "members")
        # Only nodes of this round's part look at their edges. These lie by their far end, where its community is joined, and are
        # shuffled once, to their near end; sizes go along only while there are too many communities to broadcast them.
        active = F.pmod(F.xxhash64("a", F.lit(turn // parts)) + turn, F.lit(parts)) == 0
        few = size.count() <= FREQUENT_KEYS
        carried = [] if few else ["tot", "members"]
        far = (place.where("k is not null") if few else told).select(F.col("a").alias("b"), "community", *carried)
        ends = both.where(active).join(far.hint("merge"), "b").select("a", "community", "w", *carried).repartition("a")
        ends = ends.groupBy("a", "community").agg(F.sum("w").alias("inside"), *(F.first(c).alias(c) for c in carried))
        ends = ends.join(F.broadcast(size), "community") if few else ends
        own = told.where(active).select("a", F.col("community").alias("mine"), "k", F.col("tot").alias("own_tot"), F.col("members").alias("own_members"))
        option = ends.join(own, "a")
        inside = F.sum(F.when(F.col("community") == F.col("mine"), F.col("inside"))).over(Window.partitionBy("a"))
        option = option.withColumn("own_inside", inside).where("community <> mine")
        gain = (F.col("inside") - F.coalesce("own_inside", F.lit(0.0))) / total - (F.col("tot") - (F.col("own_tot") - F.col("k"))) * F.col("k") / (total * total)
        calm = ~((F.col("own_members") == 1) & (F.col("members") == 1) & (F.col("community") > F.col("mine")))
        best = option.withColumn("gain", gain).where((F.col("gain") > 1e-12) & calm).groupBy("a").agg(F.min_by("community", F.struct(-F.col("gain"), "community")).alias("to"))
        before, place = place, materialize(place.join(best, "a", "left").select("a", F.coalesce("to", "community").alias("community"), "k", F.col("to").isNotNull().alias("moved")), "place")
        discard(before)
        discard(size)
        moved = place.where("moved").limit(1).count()
        quiet = 0 if moved else quiet + 1
        # A part of the nodes may move in a round: only when every part has been calm in turn nobody wants to.
        if quiet >= 2 * parts:
            break
    discard(both)
    name = place.groupBy("community").agg(F.min("a").alias("name"))
    return place.join(name, "community").select(F.col("a").alias("id"), F.col("name").alias("community"))


def modularity(edges: DataFrame, place: DataFrame) -> DataFrame:
    """One row: modularity of place(id, community) over the undirected weighted edges."""
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    side = lambda x: place.select(F.col("id").alias(x), F.col("community").alias(f"c{x}"))
    named = pair.join(side("a"), "a").join(side("b"), "b")
    inside = named.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("m"))
    ends = named.select(F.col("ca").alias("c"), "w").unionAll(named.select(F.col("cb").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    return inside.crossJoin(ends).select((F.col("inside") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)
