"""Scalar functions as Column expressions: globs, route pieces, versions, severities, escapes, predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: ``**`` crosses slashes, ``*`` and ``?`` don't; case doesn't matter."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"(?is)^{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(glob_pattern(glob))


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the last segment, or an empty string."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


# Beginnings of handler names by HTTP method.
VERB_WORDS = (("GET", "get list find fetch read show index"), ("POST", "create add post save new"), ("PUT", "update put edit modify"), ("DELETE", "delete remove destroy"), ("PATCH", "patch"))


def http_verb(name: Column) -> Column:
    """HTTP method that a handler's name begins with; null without any."""
    out = F
    for method, words in VERB_WORDS:
        out = out.when(F.lower(name).rlike(f"^({'|'.join(words.split())})"), method)
    return out


def name_to_path(name: Column) -> Column:
    """``getUserOrders`` and ``get_user_orders`` as ``/get/user/orders``."""
    return F.concat(F.lit("/"), F.lower(F.translate(F.regexp_replace(name, "(?<!^)([A-Z])", "/$1"), "_", "/")))


def path_in_text(text: Column) -> Column:
    """The first quoted path of a text, else the first bare one; null without any."""
    some = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.coalesce(some("[\"'](/[^\"'\\s]*)[\"']"), some("(?:^|\\s)(/[A-Za-z0-9_{}:<>/.-]+)"))


def clean_version(version: Column) -> Column:
    """A version without range operators before its first digit."""
    return F.regexp_replace(version, "^[^0-9]+", "")


def vulnerability_severity(score: Column) -> Column:
    """CRITICAL, HIGH, MEDIUM or LOW of a numeric score or of a CVSS vector's letters; UNKNOWN otherwise."""
    number = score.try_cast("double")
    high = F.regexp_count(score, F.lit(":H"))
    vector = F.when(high >= 4, 9.0).when(high >= 2, 7.0).otherwise(4.0) + F.regexp_count(score, F.lit(":N")) * 0.5
    value = F.coalesce(number, F.when(score.startswith("CVSS:"), vector))
    return F.when(value.isNull(), "UNKNOWN").when(value >= 9, "CRITICAL").when(value >= 7, "HIGH").when(value >= 4, "MEDIUM").otherwise("LOW")


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def cypher_escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def is_test(name: Column, kind: Column, file: Column) -> Column:
    """Whether a symbol looks like a test by its kind, name or file."""
    return (kind == "Test") | F.lower(name).startswith("test") | F.lower(file).rlike(r"(^|/)tests?/|_test\.|\.test\.|\.spec\.|(^|/)test_")


# Folder names that say nothing of a symbol.
DULL_FOLDERS = ("src", "source", "lib", "include", "_h", "test", "tests", "benchmark")


def rich_text(kind: Column, name: Column, parameters: Column, returns: Column, path: Column, language: Column, doc: Column) -> Column:
    """Text of a symbol for embedding; a long path keeps its last four segments after common folder names are dropped."""
    parts = F.split(path, "/")
    kept = F.filter(parts, lambda p: ~F.lower(p).isin(*DULL_FOLDERS))
    short = F.when(F.size(parts) <= 3, path).otherwise(F.array_join(F.when(F.size(kept) <= 4, kept).otherwise(F.slice(kept, -4, 4)), "/"))
    part = lambda before, c, after="": F.when(c != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    return F.concat(kind, F.lit(" "), name, parameters, part(" -> ", returns), F.lit(" in "), short, part(" [", language, "]"), part(": ", doc))
