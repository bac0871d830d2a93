"""Bridges between languages: rules of a line's text, and what each says of the foreign side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.operators.text import lines

# Kind, extensions, pattern, language, foreign language, what names the foreign symbol.
BRIDGES = (
    ("FFI", "rs", 'extern "C"', "rust", "c", "last"),
    ("FFI", "rs", "#[no_mangle]", "rust", "c", "=exported_symbol"),
    ("FFI", "rs", 'extern "system"', "rust", "c", "last"),
    ("FFI", "c h cpp hpp cc", "JNIEXPORT", "c", "java", "last"),
    ("JNI", "c h cpp hpp cc", "JNIEnv", "c", "java", "last"),
    ("JNI", "java", "native ", "java", "c", "last"),
    ("JNI", "java", "System.loadLibrary(", "java", "c", "argument"),
    ("CGO", "go", 'import "C"', "go", "c", "=C"),
    ("CGO", "go", "C.", "go", "c", "member"),
    ("P_INVOKE", "cs", "[DllImport(", "csharp", "c", "argument"),
    ("P_INVOKE", "cs", "DllImport(", "csharp", "c", "argument"),
    ("CTYPES", "py", "ctypes.CDLL(", "python", "c", "argument"),
    ("CTYPES", "py", "ctypes.cdll.LoadLibrary(", "python", "c", "argument"),
    ("CTYPES", "py", "ffi.cdef(", "python", "c", "=cffi_binding"),
    ("GRPC", "proto", "service ", "protobuf", None, "service"),
    ("GRPC", "py js ts go java rb cs rs", "_pb2_grpc", "python", None, "last"),
    ("GRPC", "go", "grpc.Dial(", "go", None, "argument"),
    ("GRPC", "java", "ManagedChannelBuilder", "java", None, "last"),
    ("GRPC", "rs", "tonic::transport::Channel", "rust", None, "last"),
    ("WASM", "rs", "#[wasm_bindgen]", "rust", "javascript", "=wasm_export"),
    ("WASM", "rs", "wasm_bindgen::JsValue", "rust", "javascript", "last"),
    ("WASM", "js ts", "WebAssembly.instantiate(", "javascript", "wasm", "argument"),
    ("WASM", "js ts", "WebAssembly.instantiateStreaming(", "javascript", "wasm", "argument"),
    ("FFI", "bas cls frm ctl", "Declare Function", "vb6", "c", "library"),
    ("FFI", "bas cls frm ctl", "Declare Sub", "vb6", "c", "library"),
    ("COM", "bas cls frm ctl", "CreateObject(", "vb6", "com", "argument"),
)


def bridge_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, k, e.split(), p, a, b, x) for n, (k, e, p, a, b, x) in enumerate(BRIDGES)], "rule int, kind string, extensions array<string>, pattern string, source_language string, target_language string, extract string")


def bridge_scan(docs: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(path, line, kind, foreign_symbol, source_language, target_language, detail): a row a line of docs(path, extension, content) and rule.

    Matching minds case. Lines are split once, and only of documents whose extension has rules and that hold a pattern at all.
    """
    rules = F.broadcast(rules if rules is not None else bridge_rules(docs.sparkSession))
    some = docs.join(rules.select(F.explode("extensions").alias("extension"), F.col("pattern").alias("hint")), "extension").where(F.col("content").contains(F.col("hint"))).select("path", "extension", "content").distinct()
    row = lines(some)
    met = row.join(rules, F.array_contains("extensions", F.col("extension")) & F.col("content").contains(F.col("pattern")))
    text = F.col("content")
    edge = lambda c, keep: F.regexp_replace(c, f"^[^{keep}]+|[^{keep}]+$", "")
    last = edge(F.regexp_extract(F.trim(text), r"(\S+)$", 1), r"\p{L}\p{N}_:")
    quoted = lambda c: F.when(c.rlike('"[^"]*"'), F.regexp_extract(c, '"([^"]*)"', 1)).otherwise(F.trim(c))
    argument = F.when(text.contains("("), F.regexp_replace(F.trim(F.regexp_extract(text, r"\(\s*([^,)]*)", 1)), '^"+|"+$', "")).otherwise(F.trim(text))
    library = F.when(F.lower(text).contains(" lib "), quoted(F.regexp_extract(text, r"(?i) lib (.*)$", 1))).otherwise(last)
    member = F.concat(F.lit("C."), F.regexp_extract(text, r"C\.([\p{L}\p{N}_]*)", 1))
    service = F.when(F.trim(text).startswith("service "), F.regexp_extract(F.trim(text), r"^service\s+(\S+)", 1)).otherwise("")
    how = F.col("extract")
    symbol = F.when(how == "last", last).when(how == "argument", argument).when(how == "library", library).when(how == "member", member).when(how == "service", service).otherwise(F.expr("substring(extract, 2)"))
    return met.select("path", F.col("line").cast("long").alias("line"), "kind", symbol.alias("foreign_symbol"), "source_language", "target_language", F.trim("content").alias("detail"))
