"""Watching a folder: files as a stream, each micro-batch indexed into a stored graph, dependents told, documents chunked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.operators.graph import cross_file
from codeweave.plans.graph import PropertyGraph
from codeweave.sources import code, documents
from codeweave.sources.walk import SKIPPED

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_changes(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """A stream of (path, ts, content) for files that are new or changed below folder, hidden ones and skipped folders left out."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    parts = F.split("path", "/")
    own = F.slice(parts, len(folder.rstrip("/").split("/")) + 1, 1000)
    return rows.where(~F.exists(own, lambda p: p.startswith(".") | p.isin(*SKIPPED))).select("path", F.col("modificationTime").alias("ts"), F.col("content").cast("string").alias("content"))


def removed(graph: PropertyGraph, listed: DataFrame) -> DataFrame:
    """(file): files that a graph's symbols name and a fresh listing (path) lacks; a folder stream doesn't tell of removals."""
    return graph.nodes["Symbol"].select("file").distinct().join(listed.select(F.col("path").alias("file")), "file", "left_anti")


def replaced(graph: PropertyGraph, files: DataFrame) -> PropertyGraph:
    """The graph with the symbols and calls of files(path, content) in place of what those files gave before."""
    changed = files.select(F.col("path").alias("file")).distinct()
    new = code.symbols(files)
    calls = code.relations(files).where("kind = 'CALLS'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "file")
    kept = lambda t: t.join(changed, "file", "left_anti")
    nodes = kept(graph.nodes["Symbol"]).unionByName(new, allowMissingColumns=True) if "Symbol" in graph.nodes else new
    edges = kept(graph.edges["CALLS"]).unionByName(calls) if "CALLS" in graph.edges else calls
    return PropertyGraph(graph.nodes | {"Symbol": nodes}, graph.edges | {"CALLS": edges})


def affected(graph: PropertyGraph, changed: DataFrame) -> DataFrame:
    """(file): files that call into changed(file) or are called from it; they are resolved again with it."""
    pairs = cross_file(graph.edges["CALLS"].select("src", "dst"), graph.nodes["Symbol"])
    return pairs.join(changed.select("file").distinct(), "file", "left_semi").select(F.col("other").alias("file")).distinct().join(changed, "file", "left_anti")


def indexer(folder: str, on_affected: Callable[[DataFrame, int], None] | None = None, refresh_every: int = 0, on_refresh: Callable[[PropertyGraph, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """What ``events.ingest`` applies to each batch of (path, content): the graph in folder gets a new version.

    on_affected is told of files to resolve again; each ``refresh_every`` batches with a change the whole graph goes to on_refresh.
    """
    seen = {"changes": 0}

    def apply(files: DataFrame, n: int) -> None:
        spark = files.sparkSession
        files = files.persist()
        try:
            if not files.limit(1).count():
                return
            try:
                graph = PropertyGraph.load(spark, folder)
            except FileNotFoundError:
                graph = PropertyGraph()
            replaced(graph, files.select("path", "content")).save(folder)
            now = PropertyGraph.load(spark, folder)
            seen["changes"] += 1
            if on_affected:
                on_affected(affected(now, files.select(F.col("path").alias("file"))), n)
            if on_refresh and refresh_every and seen["changes"] % refresh_every == 0:
                on_refresh(now, n)
        finally:
            files.unpersist()

    return apply


def document_indexer(folder: str) -> Callable[[DataFrame, int], None]:
    """What ``events.ingest`` applies to batches of documents (path, content): their chunks replace older ones in folder."""

    def apply(files: DataFrame, n: int) -> None:
        spark = files.sparkSession
        new = documents.chunks(files.select("path", F.col("content").alias("text")))
        try:
            old = PropertyGraph.load(spark, folder).nodes["Chunk"].join(files.select(F.col("path").alias("doc_file")).distinct(), "doc_file", "left_anti")
            new = old.unionByName(new)
        except FileNotFoundError:
            pass
        PropertyGraph({"Chunk": new}).save(folder)

    return apply
