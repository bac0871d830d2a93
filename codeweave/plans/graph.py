"""A property graph: node tables by label and one edge table a type, with load, save, upsert and removal."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class PropertyGraph:
    """nodes: label -> table with ``id``; edges: type -> table with ``src`` and ``dst``."""

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def cypher(self, text: str, **params) -> DataFrame:
        """The rows of a query; ``$name`` in it is a parameter."""
        from codeweave.plans.cypher import compile_query

        return compile_query(self, text, params)

    def execute(self, text: str, **params) -> PropertyGraph:
        """The graph after statements that create, merge, set, delete, copy or declare tables; this graph stays as it is."""
        from codeweave.plans.cypher_write import execute

        return execute(self, text, params)

    def schema(self) -> dict[str, list[str]]:
        """Columns of every label and edge type."""
        return {name: table.columns for name, table in [*self.nodes.items(), *self.edges.items()]}

    def stats(self) -> DataFrame:
        """(name, rows) of every label and type, in one job."""
        parts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in [*self.nodes.items(), *self.edges.items()]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def checked(self) -> PropertyGraph:
        """Without repeated nodes and edges and without edges whose ends are no nodes."""
        nodes = {k: t.dropDuplicates(["id"]) for k, t in self.nodes.items()}
        known = None
        for t in nodes.values():
            ids = t.select(F.col("id").cast("string").alias("known"))
            known = ids if known is None else known.unionAll(ids)
        keep = lambda e: e.distinct().join(known, F.col("src").cast("string") == F.col("known"), "left_semi").join(known, F.col("dst").cast("string") == F.col("known"), "left_semi")
        return PropertyGraph(nodes, {k: keep(e) for k, e in self.edges.items()})

    def save(self, folder: str) -> str:
        """Write a new version below folder and make it the current one; readers of older versions are not disturbed.

        The version's list of tables is written last, under a name that counts up: it is there as a whole or not at all, so a reader
        finds the old version or the new one, and a crash leaves the old one.
        """
        version = f"v-{uuid.uuid4().hex}"
        for kind, tables in (("nodes", self.nodes), ("edges", self.edges)):
            for name, table in tables.items():
                table.write.parquet(f"{folder}/{version}/{kind}/{name}")
        spark = next(iter([*self.nodes.values(), *self.edges.values()])).sparkSession
        rows = [(version, k, n) for k, t in (("nodes", self.nodes), ("edges", self.edges)) for n in t]
        turn = (_versions(spark, folder) or [0])[-1] + 1
        spark.createDataFrame(rows, "version string, kind string, name string").coalesce(1).write.parquet(f"{folder}/_version-{turn:010d}")
        return version

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> PropertyGraph:
        out = cls()
        turns = _versions(spark, folder)
        if not turns:
            raise FileNotFoundError(f"no graph in {folder}")
        for version, kind, name in spark.read.parquet(f"{folder}/_version-{turns[-1]:010d}").collect():
            getattr(out, kind)[name] = spark.read.parquet(f"{folder}/{version}/{kind}/{name}")
        return out

    def without(self, ids: DataFrame) -> PropertyGraph:
        """Nodes in ids(id) and all their edges removed."""
        gone = ids.select("id").distinct()
        cut = lambda e: e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(e.columns)
        return PropertyGraph({k: t.join(gone, "id", "left_anti") for k, t in self.nodes.items()}, {k: cut(e) for k, e in self.edges.items()})

    def merged(self, label: str, updates: DataFrame) -> PropertyGraph:
        """Nodes of updates inserted, or their given columns set where the id exists."""
        from codeweave.operators.changes import merge

        return PropertyGraph(self.nodes | {label: merge(self.nodes[label], updates, "id")}, self.edges)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions whose lists are complete, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_version-*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().split("-")[1]) for f in found)
