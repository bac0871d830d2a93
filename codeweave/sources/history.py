"""Version history as tables: changed files, their status, commits. ``output`` runs git where the repository lies; the rest is Spark."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a commit in the log, told apart by a byte that no name has.
LOG = "--format=%H%x1f%an%x1f%at%x1f%s"


def output(root: str, *arguments: str) -> str:
    """What git prints; raises if it fails."""
    return subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, check=True).stdout


def commits(spark: SparkSession, log: str) -> DataFrame:
    """(commit, author, ts, subject) of a log in LOG's format."""
    rows = spark.createDataFrame([(x,) for x in log.splitlines() if x], "row string")
    part = F.split("row", "\x1f")
    return rows.select(part[0].alias("commit"), part[1].alias("author"), F.timestamp_seconds(part[2].cast("long")).alias("ts"), part[3].alias("subject"))


def statuses(spark: SparkSession, text: str) -> DataFrame:
    """(status, file, old_file) of ``diff --name-status``: A, D, M, R or C; old_file for renames and copies."""
    rows = spark.createDataFrame([(x,) for x in text.splitlines() if x], "row string")
    part = F.split("row", "\t")
    moved = F.size(part) > 2
    return rows.select(F.substring(part[0], 1, 1).alias("status"), F.when(moved, F.get(part, 2)).otherwise(part[1]).alias("file"), F.when(moved, part[1]).alias("old_file"))


def diff_texts(spark: SparkSession, root: str, log: DataFrame) -> DataFrame:
    """(commit, text) for ``changes.hunks``: the unified diff of each commit; the commits asked for are a reader's page of a log."""
    ids = [r[0] for r in log.select("commit").collect()]
    return spark.createDataFrame([(c, output(root, "show", "--unified=0", "--format=", c)) for c in ids], "commit string, text string")
