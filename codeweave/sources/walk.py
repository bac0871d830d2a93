"""Files of a project: a distributed walk with ignore rules, documents among them, binary vectors, session files."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never entered, and extensions of documents.
SKIPPED = ("node_modules", "__pycache__", ".tox", ".git", ".venv", "venv")
DOCUMENTS = ("md", "markdown", "mdx", "txt", "rst", "adoc", "org", "tex", "log", "csv", "html", "htm", "xml", "rtf", "pdf", "docx", "pptx", "xlsx", "json")


def ignore_rules(text: str, base: str = "") -> list[tuple[str, bool]]:
    """(regular expression of relative paths, whether it brings them back) of an ignore file in folder ``base``, in file order.

    A rule with a slash before its end is tied to the folder, others match at any depth; one that ends in a slash means folders only;
    ``**`` crosses slashes; ``!`` brings back.
    """
    out = []
    for row in text.splitlines():
        row = row.rstrip()
        if not row or row.startswith("#"):
            continue
        back, row = row.startswith("!"), row.removeprefix("!").removeprefix("\\")
        only_folders, row = row.endswith("/"), row.rstrip("/")
        tied, row = "/" in row, row.lstrip("/")
        body, i = "", 0
        while i < len(row):
            if row.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif row.startswith("**", i):
                body, i = body + ".*", i + 2
            else:
                c = row[i]
                body, i = body + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
        front = re.escape(f"{base}/") if base else ""
        out.append((f"^{front}{'' if tied else '(?:.*/)?'}{body}{'/.+' if only_folders else '(?:/.+)?'}$", back))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that fits a relative path ignores it."""
    out = F
    for pattern, back in reversed(rules):
        out = out.when(path.rlike(pattern), not back)
    return out.otherwise(False) if rules else F.lit(False)


def walked(spark: SparkSession, root: str, ignore_names: tuple[str, ...] = (".gitignore", ".codeweaveignore"), skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, extension, content, content_hash) of the files below root, paths relative, without hidden ones, skipped folders and ignored files.

    Files are listed and read by Spark; only the folders' names and their ignore files come to the driver.
    """
    read = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True)
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(base)}/", "")
    files = read().load(root).select(relative.alias("path"), "content")
    # Spark doesn't list hidden files, so each folder that holds files is asked for its ignore files.
    folders = {""}
    for (folder,) in files.select(F.regexp_replace("path", "/?[^/]*$", "")).distinct().collect():
        parts = folder.split("/")
        folders |= {"/".join(parts[:n]) for n in range(1, len(parts) + 1)}
    jvm, rules = spark._jvm, []
    place = jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in sorted(folders, key=lambda f: (f.count("/") + bool(f), f)):
        for name in ignore_names:
            path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{folder}/{name}" if folder else f"{root.rstrip('/')}/{name}")
            if system.exists(path):
                stream = system.open(path)
                try:
                    rules += ignore_rules(bytes(stream.readAllBytes()).decode("utf-8", "replace"), folder)
                finally:
                    stream.close()
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*skipped))
    kept = files.where(~hidden & ~ignored(F.col("path"), rules))
    return kept.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("content_hash"))


def documents_of(files: DataFrame) -> DataFrame:
    """The documents among files(path, extension, ...)."""
    return files.where(F.col("extension").isin(*DOCUMENTS))


def binary_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of files that hold a count, then for each vector the length of its id, the id, its dimension and 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                (count,), at, ids, vectors = struct.unpack_from("<I", raw), 4, [], []
                for k in range(count):
                    (n,) = struct.unpack_from("<I", raw, at)
                    ids.append(raw[at + 4 : at + 4 + n].decode())
                    (dim,) = struct.unpack_from("<I", raw, at + 4 + n)
                    vectors.append(struct.unpack_from(f"<{dim}f", raw, at + 8 + n))
                    at += 8 + n + 4 * dim
                    if len(ids) == 10_000 or k == count - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], ["id", "embedding"])
                        ids, vectors = [], []

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id string, embedding array<float>")


SESSION = "id string, summary string, decisions string, files array<string>, created_at long, updated_at long"


def recent_sessions(spark: SparkSession, path: str, k: int | None = None, by: str = "updated_at") -> DataFrame:
    """Sessions stored as JSON files, newest first; fields that a file lacks are null."""
    rows = spark.read.schema(SESSION).option("multiLine", True).json(path).orderBy(F.desc(by), "id")
    return rows if k is None else rows.limit(k)


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines."""
    rows.write.mode("append").json(path)


def line_of_offset(text: Column, offset: Column) -> Column:
    """1-based line of a character offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1
