"""Code indexes in the public SCIP protobuf format: occurrences as rows, and the calls that follow from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.operators.graph import innermost

OCCURRENCES = "file string, language string, line int, symbol string, is_definition boolean"
# Fixed values of the format: field numbers of an index's documents, of a document and of an occurrence; the definition role.
DOCUMENTS, PATH, OCCURRENCE, LANGUAGE, RANGE, SYMBOL, ROLES, DEFINITION = 2, 1, 2, 4, 1, 2, 3, 1


def _varint(raw: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


def fields(raw: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message: varints as numbers, other fields as bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def document_rows(raw: memoryview) -> Iterator[tuple]:
    """Occurrences of one document; lines count from 1; local symbols and such without a name are left out."""
    parts = list(fields(raw))
    path = next((bytes(v).decode() for n, v in parts if n == PATH), "")
    language = next((bytes(v).decode() for n, v in parts if n == LANGUAGE), "")
    for n, v in parts:
        if n == OCCURRENCE:
            line, symbol, roles = 0, "", 0
            for k, w in fields(v):
                if k == RANGE:
                    line = _varint(w, 0)[0] if isinstance(w, memoryview) and len(w) else w if isinstance(w, int) else 0
                elif k == SYMBOL:
                    symbol = bytes(w).decode()
                elif k == ROLES:
                    roles = w
            if symbol and not symbol.startswith(("local ", "<")):
                yield path, language, line + 1, symbol, bool(roles & DEFINITION)


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, language, line, symbol, is_definition) of index files; a file is read by one task, a document at a time."""
    schema = pa.schema([("file", pa.string()), ("language", pa.string()), ("line", pa.int32()), ("symbol", pa.string()), ("is_definition", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for number, value in fields(memoryview(content.as_buffer())):
                    if number == DOCUMENTS and (rows := list(document_rows(value))):
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, OCCURRENCES)


def calls(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst): from the innermost symbol around each reference to the innermost one around the definition, without loops.

    found: ``occurrences``; symbols(id, file, start_line, end_line). Of several definitions of a symbol the first by file and line counts.
    """
    spans = symbols.select("file", "id", "start_line", "end_line")
    inside = innermost(spans, found.select("file", "line").distinct())
    where = found.where("is_definition").groupBy("symbol").agg(F.min(F.struct("file", "line")).alias("at")).select("symbol", "at.file", "at.line")
    target = where.join(inside, ["file", "line"]).select("symbol", F.col("id").alias("dst"))
    source = found.where("not is_definition").join(inside, ["file", "line"]).select("symbol", F.col("id").alias("src"))
    return source.join(target, "symbol").where("src <> dst").select("src", "dst").distinct()
