"""Exports, incremental embeddings, session and learned stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.functions.scalars import cypher_escape, xml_escape


def json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): a JSON object a node and edge; null fields are left out."""
    return nodes.select(F.lit("nodes").alias("part"), F.to_json(F.struct("*")).alias("value")).unionAll(edges.select(F.lit("edges").alias("part"), F.to_json(F.struct("*")).alias("value")))


def cypher_script(nodes: DataFrame, edges: DataFrame, label: str, kind: str) -> DataFrame:
    """(value): a CREATE statement a node, then a MATCH ... CREATE a edge."""
    text = lambda c: F.concat(F.lit(f"{c}: '"), cypher_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("'"))
    made = nodes.select(F.concat(F.lit(f"CREATE (:{label} {{"), F.concat_ws(", ", *(text(c) for c in nodes.columns)), F.lit("});")).alias("value"))
    end = lambda v, c: F.concat(F.lit(f"({v}:{label} {{id: '"), cypher_escape(F.col(c).cast("string")), F.lit("'})"))
    tied = edges.select(F.concat(F.lit("MATCH "), end("a", "src"), F.lit(", "), end("b", "dst"), F.lit(f" CREATE (a)-[:{kind}]->(b);")).alias("value"))
    return made.unionAll(tied)


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): GraphML elements; a document is header, nodes, edges, footer in this order of parts."""
    data = lambda t: F.concat_ws("", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), xml_escape(F.col(c).cast("string")), F.lit("</data>"))).otherwise("") for c in t.columns if c not in ("id", "src", "dst")))
    at = lambda name, c: F.concat(F.lit(f' {name}="'), xml_escape(F.col(c).cast("string")), F.lit('"'))
    spark = nodes.sparkSession
    keys = "".join(f'<key id="{c}" for="{kind}" attr.name="{c}" attr.type="string"/>' for kind, t in (("node", nodes), ("edge", edges)) for c in t.columns if c not in ("id", "src", "dst"))
    ends = spark.createDataFrame([(0, f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, value string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("<node"), at("id", "id"), F.lit(">"), data(nodes), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit("<edge"), at("source", "src"), at("target", "dst"), F.lit(">"), data(edges), F.lit("</edge>")).alias("value"))
    return ends.unionAll(n).unionAll(e)


def refreshed_embeddings(stored: DataFrame, texts: DataFrame, changed: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(id, embedding): texts(id, file, text) embedded where new or in changed(file); others kept; those without a text dropped."""
    have = stored.select("id", "embedding")
    again = texts.join(changed.select("file").distinct(), "file", "left_semi").select("id")
    new = texts.select("id").join(have, "id", "left_anti")
    todo = again.union(new).distinct()
    made = texts.join(todo, "id", "left_semi").select("id", embed(F.col("text")).alias("embedding"))
    kept = have.join(texts.select("id"), "id", "left_semi").join(todo, "id", "left_anti")
    return kept.unionByName(made)


def merged_sessions(rows: DataFrame) -> DataFrame:
    """Sessions of one day as one: the last summary, decisions in order joined by `` | ``, files once each, first and last time.

    rows(user_id, ts, summary, decision, files array).
    """
    day = rows.withColumn("day", F.to_date("ts"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ts", c))), lambda x: x[c])
    return day.groupBy("user_id", "day").agg(
        F.max_by("summary", "ts").alias("summary"),
        F.array_join(F.filter(ordered("decision"), lambda x: x != ""), " | ").alias("decisions"),
        F.array_distinct(F.flatten(ordered("files"))).alias("files"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )


def purged(sessions: DataFrame, cutoff: str, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Sessions created at or after the cutoff, and the vectors that belong to them."""
    kept = sessions.where(F.col("created_at") >= F.lit(cutoff).cast("timestamp"))
    return kept, vectors.join(kept.select("id"), "id", "left_semi") if vectors is not None else None
