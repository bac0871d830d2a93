"""Unified search: two blends of lexical and vector scores, grep hits, and a wider second try."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.operators.text import bm25, grep
from codeweave.operators.vectors import hybrid, nearest
from codeweave.session import materialize


def containing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """points(path, line) with the first symbol (by start line, then id) whose lines hold each: (path, line, id)."""
    inside = points.join(symbols, points["path"] == symbols["file"]).where("start_line <= line and line <= end_line")
    return inside.groupBy("path", "line").agg(F.min(F.struct("start_line", "id")).getField("id").alias("id"))


def unified(docs: DataFrame, vectors: DataFrame, query_vector: list[float], query: str, k: int, symbols: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(id, score) of the k best of docs(id, content) and vectors(id, embedding).

    The blends with vector shares 0.3 and 0.85 are merged by the larger score; with symbols(id, file, start_line, end_line) and
    files(path, content), each line that holds the query adds 0.05 to the symbol around it if it was found. A weak result (best
    under 0.4, or fewer than 3) is tried again three times as wide, up to 100.
    """

    def once(n: int) -> DataFrame:
        lexical = materialize(bm25(docs, query).orderBy(F.desc("score"), "id").limit(2 * n), "lexical")
        near = materialize(nearest(vectors, query_vector, 2 * n), "nearest")
        both = hybrid(lexical, near, 0.3, n).unionByName(hybrid(lexical, near, 0.85, n))
        return both.groupBy("id").agg(F.max("score").alias("score"))

    found = materialize(once(k), "found")
    best, n = found.agg(F.max("score"), F.count("*")).first()
    if k < 100 and (n < 3 or best < 0.4):
        found = found.unionByName(once(min(3 * k, 100))).groupBy("id").agg(F.max("score").alias("score"))
    if symbols is not None and files is not None:
        import re

        hits = containing(grep(files, re.escape(query)).select("path", "line"), symbols).groupBy("id").agg(F.count("*").alias("hits"))
        found = found.join(hits, "id", "left").select("id", (F.col("score") + F.lit(0.05) * F.coalesce("hits", F.lit(0))).alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(k)
