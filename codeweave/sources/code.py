"""Extraction of symbols and relations from source files, and of dependencies from manifests.

Python is read with ``ast``; other languages by packs of line patterns; SQL by its table references. A pack is any function
``(path, content) -> (symbols, relations)``; ``register`` adds one for an extension.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SYMBOLS = "id string, name string, kind string, file string, start_line int, end_line int, signature_hash string, parent string, docstring string, complexity int, parameters string, return_type string"
RELATIONS = "source_id string, target_id string, kind string, file string, line int, receiver string"
DEPENDENCIES = "id string, name string, version string, ecosystem string, is_dev boolean, file string"
Pack = Callable[[str, str], tuple[list[tuple], list[tuple]]]

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.comprehension, ast.match_case)


def _complexity(node: ast.AST) -> int:
    """One, and one more for each branch and each further operand of a boolean expression."""
    return 1 + sum(isinstance(n, _BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(node))


def python_pack(path: str, content: str) -> tuple[list[tuple], list[tuple]]:
    """Classes, functions, methods and module constants; calls, imports and inheritance. A file that doesn't parse has none."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    symbols, relations = [], []

    def add(node, name: str, kind: str, owner: str | None) -> str:
        own = f"{path}::{owner}::{name}" if owner else f"{path}::{name}"
        source = ast.get_source_segment(content, node) or ""
        doc = (ast.get_docstring(node) or "") if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else ""
        function = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef))
        symbols.append((own, name, kind, path, node.lineno, node.end_lineno, hashlib.sha256(source.encode()).hexdigest()[:16], f"{path}::{owner}" if owner else "", doc, _complexity(node) if function else 0, f"({ast.unparse(node.args)})" if function else "", ast.unparse(node.returns) if function and node.returns else ""))
        return own

    def visit(node: ast.AST, owner: str | None, scope: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                own = add(child, child.name, "Class", None)
                for base in child.bases:
                    relations.append((own, f"{path}::{ast.unparse(base).split('.')[-1]}", "Inherits", path, child.lineno, ""))
                visit(child, child.name, own)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "Test" if child.name.startswith("test") else "Method" if owner else "Function"
                own = add(child, child.name, kind, owner)
                visit(child, owner, own)
            else:
                if isinstance(child, ast.Call):
                    f = child.func
                    name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if name:
                        receiver = ast.unparse(f.value) if isinstance(f, ast.Attribute) else ""
                        relations.append((scope, f"{path}::{name}", "Calls", path, child.lineno, owner or "" if receiver in ("self", "cls") else receiver))
                elif isinstance(child, ast.Import):
                    relations.extend((path, f"{path}::{a.name}", "Imports", path, child.lineno, "") for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    relations.append((path, f"{path}::{child.module or ''}", "Imports", path, child.lineno, ""))
                elif isinstance(child, ast.Assign) and scope == path:
                    for t in child.targets:
                        if isinstance(t, ast.Name):
                            add(child, t.id, "Constant" if t.id.isupper() else "Variable", None)
                visit(child, owner, scope)

    visit(tree, None, path)
    first = {}
    for s in symbols:
        if s[0] not in first or (s[2] == "Test" and first[s[0]][2] == "Function"):
            first[s[0]] = s
    return list(first.values()), relations


_CLASS, _FN = r"^\s*(?:[\w@]+\s+)*class\s+(\w+)", r"^\s*(?:[\w@]+\s+)*(?:function|func|fun|fn|def|sub|proc|procedure)\s+(?:\w+[.:])?(\w+[?!]?)"
#: Line patterns of languages without a parser here: (kind, pattern with the name as group 1).
PATTERNS = {
    "js ts jsx tsx mjs cjs": (("Class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("Function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("Function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"), ("Interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("Enum", r"^\s*(?:export\s+)?enum\s+(\w+)"), ("Method", r"^\s+(?:(?:public|private|protected|static|async|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b)(\w+)\s*\([^;]*\)\s*(?::\s*[\w<>\[\]| ]+)?\{")),
    "go": (("Function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]"), ("Struct", r"^type\s+(\w+)\s+struct\b"), ("Interface", r"^type\s+(\w+)\s+interface\b")),
    "rs": (("Function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\S+\s+)*fn\s+(\w+)"), ("Struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("Trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), ("Enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("Module", r"^\s*(?:pub\s+)?mod\s+(\w+)")),
    "java cs kt kts groovy": (("Class", r"^\s*(?:\w+\s+)*class\s+(\w+)"), ("Interface", r"^\s*(?:\w+\s+)*interface\s+(\w+)"), ("Enum", r"^\s*(?:\w+\s+)*enum\s+(\w+)"), ("Struct", r"^\s*(?:\w+\s+)*(?:struct|record)\s+(\w+)"), ("Method", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(\w+)\s*\("), ("Method", r"^\s+(?:public|private|protected|internal|static|final|override|async|def|\s)+[\w<>\[\],.? ]*?\b(\w+)\s*\([^;]*\)\s*(?:throws [\w, .]+)?\{")),
    "rb cr": (("Class", r"^\s*(?:abstract\s+)?class\s+(\w+)"), ("Module", r"^\s*module\s+(\w+)"), ("Method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")),
    "php": (("Class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)"), ("Interface", r"^\s*interface\s+(\w+)"), ("Trait", r"^\s*trait\s+(\w+)"), ("Function", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(\w+)")),
    "c h cpp hpp cc cxx hh m mm cu": (("Function", r"^[\w*&:<>]+[\w\s*&:<>]*?\b(\w+)\s*\([^;]*\)\s*(?:const\s*)?\{"), ("Struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*(?:\{|:|$)"), ("Class", r"^\s*class\s+(\w+)"), ("Class", r"^@(?:interface|implementation)\s+(\w+)"), ("Enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(\w+)")),
    "swift": (("Class", _CLASS), ("Struct", r"^\s*(?:\w+\s+)*struct\s+(\w+)"), ("Interface", r"^\s*(?:\w+\s+)*protocol\s+(\w+)"), ("Enum", r"^\s*(?:\w+\s+)*enum\s+(\w+)"), ("Function", r"^\s*(?:\w+\s+)*func\s+(\w+)")),
    "scala sc": (("Class", r"^\s*(?:\w+\s+)*class\s+(\w+)"), ("Trait", r"^\s*(?:\w+\s+)*trait\s+(\w+)"), ("Module", r"^\s*(?:\w+\s+)*object\s+(\w+)"), ("Function", r"^\s*(?:\w+\s+)*def\s+(\w+)")),
    "dart": (("Class", r"^\s*(?:abstract\s+)?class\s+(\w+)"), ("Enum", r"^\s*enum\s+(\w+)"), ("Function", r"^\s*(?:static\s+)?[\w<>?,]+\s+(?!return\b)(\w+)\s*\([^;]*\)\s*(?:async\s*)?\{")),
    "lua": (("Function", r"^\s*(?:local\s+)?function\s+(?:\w+[.:])*(\w+)"),),
    "pl pm": (("Module", r"^\s*package\s+([\w:]+)"), ("Function", r"^\s*sub\s+(\w+)")),
    "r": (("Function", r"^\s*([\w.]+)\s*(?:<-|=)\s*function\s*\("),),
    "jl": (("Struct", r"^\s*(?:mutable\s+)?struct\s+(\w+)"), ("Module", r"^\s*module\s+(\w+)"), ("Function", r"^\s*function\s+([\w.]+!?)"), ("Function", r"^(\w+!?)\([^)]*\)\s*=")),
    "ex exs": (("Module", r"^\s*defmodule\s+([\w.]+)"), ("Interface", r"^\s*defprotocol\s+([\w.]+)"), ("Function", r"^\s*defp?\s+(\w+[?!]?)")),
    "erl hrl": (("Module", r"^-module\((\w+)\)"), ("Function", r"^([a-z]\w*)\([^)]*\)\s*(?:when\b.*)?->")),
    "hs": (("Module", r"^module\s+([\w.]+)"), ("Struct", r"^(?:data|newtype)\s+(\w+)"), ("Interface", r"^class\s+(?:.*=>\s*)?(\w+)"), ("Function", r"^([a-z]\w*)\s*::")),
    "ml mli fs fsi": (("Module", r"^\s*module\s+(\w+)"), ("Struct", r"^\s*type\s+(\w+)"), ("Function", r"^\s*let\s+(?:rec\s+|inline\s+)*(\w+)")),
    "clj cljs cljc": (("Module", r"^\(ns\s+([\w.-]+)"), ("Interface", r"^\(defprotocol\s+([\w-]+)"), ("Struct", r"^\(defrecord\s+([\w-]+)"), ("Function", r"^\(defn-?\s+([\w?!*-]+)")),
    "el lisp scm rkt": (("Function", r"^\s*\((?:defun|define|defmacro)\s+\(?([\w?!*-]+)"),),
    "sh bash zsh": (("Function", r"^\s*(?:function\s+)?(\w[\w-]*)\s*\(\)\s*\{?"), ("Function", r"^\s*function\s+(\w[\w-]*)")),
    "ps1 psm1": (("Class", r"(?i)^\s*class\s+(\w+)"), ("Function", r"(?i)^\s*function\s+([\w-]+)")),
    "vb bas cls frm ctl": (("Class", r"(?i)^\s*(?:\w+\s+)*class\s+(\w+)"), ("Module", r"(?i)^\s*(?:\w+\s+)*module\s+(\w+)"), ("Function", r"(?i)^\s*(?:(?:public|private|friend|static|shared)\s+)*(?:function|sub|property\s+(?:get|let|set))\s+(\w+)")),
    "pas pp dpr": (("Class", r"(?i)^\s*(\w+)\s*=\s*class\b"), ("Function", r"(?i)^\s*(?:function|procedure|constructor|destructor)\s+(?:\w+\.)?(\w+)")),
    "f f90 f95 for": (("Module", r"(?i)^\s*module\s+(?!procedure)(\w+)"), ("Function", r"(?i)^\s*(?!end\b)(?:[\w()=*]+\s+)*(?:subroutine|function)\s+(\w+)")),
    "cob cbl": (("Module", r"(?i)^\s*program-id\.\s+([\w-]+)"), ("Function", r"(?i)^\s{7,11}([\w-]+)\s+section\.")),
    "adb ads": (("Module", r"(?i)^\s*package\s+(?:body\s+)?([\w.]+)"), ("Function", r"(?i)^\s*(?:function|procedure)\s+(\w+)")),
    "zig": (("Function", r"^\s*(?:pub\s+)?(?:export\s+)?fn\s+(\w+)"), ("Struct", r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:packed\s+|extern\s+)?struct\b")),
    "nim": (("Function", r"^\s*(?:proc|func|method|iterator|template|macro)\s+(\w+)"), ("Struct", r"^\s*(\w+)\*?\s*=\s*(?:ref\s+)?object\b")),
    "d": (("Class", _CLASS), ("Struct", r"^\s*struct\s+(\w+)"), ("Interface", r"^\s*interface\s+(\w+)"), ("Function", r"^\s*[\w!()\[\]]+\s+(?!return\b)(\w+)\s*\([^;]*\)\s*\{")),
    "v sv vh": (("Module", r"^\s*module\s+(\w+)"), ("Function", r"^\s*(?:function|task)\s+(?:automatic\s+)?(?:[\w\[\]:]+\s+)?(\w+)")),
    "vhd vhdl": (("Module", r"(?i)^\s*entity\s+(\w+)"), ("Function", r"(?i)^\s*(?:function|procedure)\s+(\w+)")),
    "sol": (("Class", r"^\s*(?:abstract\s+)?contract\s+(\w+)"), ("Interface", r"^\s*interface\s+(\w+)"), ("Struct", r"^\s*struct\s+(\w+)"), ("Function", r"^\s*(?:function|modifier|event)\s+(\w+)")),
    "gd": (("Class", r"^\s*class(?:_name)?\s+(\w+)"), ("Function", r"^\s*(?:static\s+)?func\s+(\w+)")),
    "proto": (("Class", r"^\s*service\s+(\w+)"), ("Struct", r"^\s*message\s+(\w+)"), ("Enum", r"^\s*enum\s+(\w+)"), ("Method", r"^\s*rpc\s+(\w+)")),
    "graphql gql": (("Struct", r"^\s*(?:type|input)\s+(\w+)"), ("Interface", r"^\s*interface\s+(\w+)"), ("Enum", r"^\s*enum\s+(\w+)"), ("Function", r"^\s*(?:query|mutation|subscription|fragment)\s+(\w+)")),
    "thrift": (("Class", r"^\s*service\s+(\w+)"), ("Struct", r"^\s*(?:struct|exception|union)\s+(\w+)"), ("Enum", r"^\s*enum\s+(\w+)")),
    "tf hcl": (("Struct", r"^\s*(?:resource|data)\s+\"[\w-]+\"\s+\"([\w-]+)\""), ("Variable", r"^\s*(?:variable|output|module|provider)\s+\"([\w-]+)\"")),
    "cmake": (("Function", r"(?i)^\s*(?:function|macro)\s*\(\s*(\w+)"), ("Module", r"(?i)^\s*add_(?:executable|library)\s*\(\s*([\w-]+)")),
    "mk": (("Function", r"^([\w./-]+)\s*:(?!=)"),),
    "md rst": (("Section", r"^#{1,6}\s+(.+?)\s*$"),),
}

# Words that look like calls but aren't, words that branch, comment and attribute openings.
NO_CALLS = frozenset("if for while switch catch return sizeof typeof new function fn func def sub class and or not in match when until unless elif else elsif foreach using lock fixed print defer go select case where with except raise throw assert let var const val".split())
CONTROL = frozenset("if for while switch catch return else do try using lock foreach elif when until match".split())
BRANCHES = re.compile(r"\b(?:if|elif|elsif|else if|for|foreach|while|until|unless|case|when|catch|except|rescue|guard)\b|&&|\|\||\?\?|\band\b|\bor\b")
COMMENT = re.compile(r"^\s*(?://[/!]?|#(?!\[)|--|;+|%|'|\*(?!/)|/\*+!?|\"\"\")\s?(.*?)(?:\*/)?\s*$")
ATTRIBUTE = re.compile(r"^\s*(?:@\w|#\[|\[\w)")
IMPORT = re.compile(r"^\s*(?:import|from|use|using|require|require_once|include|#include|open|alias|library|source|@import)\b[\s(]*(?:static\s+|\w+\s+from\s+|\{[^}]*\}\s+from\s+|\*\s+as\s+\w+\s+from\s+)?[\"'<]?([\w./:\\@-]+)")
INHERIT = re.compile(r"\b(?:class|interface|struct|contract|protocol|trait)\s+\w+(?:<[^>]*>)?\s*(?:\(([^)]*)\)|(?:extends|:|<(?!\w+>)|is|inherits)\s*([\w.,:<> ]+))?(?:\s+implements\s+([\w.,<> ]+))?")
CALL = re.compile(r"(?:(\w+)\s*(?:\.|->|::)\s*)?\b([A-Za-z_]\w*[?!]?)\s*\(")


def _documented(lines: list[str], n: int) -> str:
    """Comment and attribute lines right above line n (from 1), comment marks and ends dropped."""
    out, at = [], n - 2
    while at >= 0:
        row = lines[at]
        m = COMMENT.match(row)
        if ATTRIBUTE.match(row):
            out.append(row.strip())
        elif m and row.strip():
            out.append(m[1].strip())
        elif row.strip() not in ("*/", "/**", "/*"):
            break
        at -= 1
    return "\n".join(x for x in reversed(out) if x)


def line_pack(patterns) -> Pack:
    """A pack that finds declarations by line; a symbol ends before the next one.

    Its documentation is the comment above it, its complexity one more than its branches. Relations: calls within a symbol with what
    they are called on, imports, and the parents that a type's line names.
    """
    compiled = [(kind, re.compile(p)) for kind, p in patterns]

    def run(path: str, content: str) -> tuple[list[tuple], list[tuple]]:
        found, lines = {}, content.split("\n")
        for n, line in enumerate(lines, 1):
            for kind, p in compiled:
                m = p.match(line)
                if m and m[1] not in CONTROL:
                    found.setdefault(f"{path}::{m[1]}", (m[1], kind, n))
                    break
        starts = sorted(v[2] for v in found.values()) + [len(lines) + 1]
        symbols, relations = [], []
        for n, line in enumerate(lines, 1):
            if m := IMPORT.match(line):
                relations.append((path, f"{path}::{m[1]}", "IMPORTS", path, n, ""))
        for own, (name, kind, n) in found.items():
            end = next(s for s in starts if s > n) - 1
            body = lines[n - 1 : end]
            branches = sum(len(BRANCHES.findall(x)) for x in body) if kind in ("Function", "Method") else 0
            symbols.append((own, name, kind, path, n, end, hashlib.sha256("\n".join(body).encode()).hexdigest()[:16], "", _documented(lines, n), 1 + branches if kind in ("Function", "Method") else 0, "", ""))
            if kind in ("Class", "Interface", "Struct", "Trait") and (m := INHERIT.search(body[0])):
                parents = ",".join(g for g in m.groups() if g)
                for parent in re.findall(r"[\w.:]+", re.sub(r"<[^>]*>|\b(?:public|private|protected|virtual|with|extends|implements)\b", "", parents)):
                    relations.append((own, f"{path}::{re.split(r'[.:]+', parent)[-1]}", "INHERITS", path, n, ""))
            if kind in ("Function", "Method"):
                for k, line in enumerate(body):
                    if IMPORT.match(line) or (COMMENT.match(line) and line.strip()):
                        continue
                    for m in CALL.finditer(line):
                        if m[2].lower() not in NO_CALLS and not (k == 0 and m[2] == name):
                            relations.append((own, f"{path}::{m[2]}", "CALLS", path, n + k, m[1] or ""))
        return symbols, relations

    return run


_TARGET = re.compile(r"\b(?:create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)(?:\s+if\s+not\s+exists)?|insert(?:\s+overwrite)?(?:\s+into)?(?:\s+table)?|merge\s+into)\s+([\w.`\"]+)", re.I)
_SOURCE = re.compile(r"\b(?:from|join|using)\s+([\w.`\"]+)", re.I)
_COMMON = re.compile(r"(?:\bwith\b(?:\s+recursive)?|,)\s*([\w`\"]+)\s+as\s*\(", re.I)


def sql_pack(path: str, content: str) -> tuple[list[tuple], list[tuple]]:
    """Tables a script creates or fills, and CALLS edges to the tables each statement reads; common table expressions don't count."""
    clean = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), content, flags=re.S)
    symbols, relations, at = {}, [], 0
    for statement in clean.split(";"):
        line = clean.count("\n", 0, at) + 1
        m = _TARGET.search(statement)
        if m:
            name = lambda x: re.sub(r'[`"]', "", x)
            own, common = name(m[1]), {name(c).lower() for c in _COMMON.findall(statement)}
            start = line + statement.count("\n", 0, m.start())
            symbols.setdefault(own, (f"{path}::{own}", own, "Class", path, start, line + statement.count("\n"), hashlib.sha256(statement.encode()).hexdigest()[:16], "", "", 0, "", ""))
            for s in _SOURCE.finditer(statement, m.end()):
                if name(s[1]).lower() not in common and not name(s[1]).lower() in ("select", own.lower()):
                    relations.append((f"{path}::{own}", f"{path}::{name(s[1])}", "Calls", path, line + statement.count("\n", 0, s.start()), ""))
        at += len(statement) + 1
    return list(symbols.values()), relations


PACKS: dict[str, Pack] = {"py": python_pack, "sql": sql_pack} | {e: line_pack(p) for names, p in PATTERNS.items() for e in names.split()}


def register(extension: str, pack: Pack) -> None:
    PACKS[extension.lower().lstrip(".")] = pack


def _extract(files: DataFrame, which: int, schema: str) -> DataFrame:
    packs = dict(PACKS)
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                pack = packs.get(path.rpartition(".")[2].lower()) if path else None
                if pack and content:
                    rows += pack(path, content)[which]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files(path, content) by the pack of each extension; unknown extensions and null contents have none."""
    return _extract(files, 0, SYMBOLS)


def relations(files: DataFrame) -> DataFrame:
    """Raw relations of files(path, content); targets are local names until they are resolved."""
    return _extract(files, 1, RELATIONS)


def dependencies_of(path: str, content: str) -> list[tuple]:
    """Dependency rows of one manifest; a file that can't be read has none."""
    base, out = path.rpartition("/")[2], []

    def add(eco: str, name: str, version: object, dev: bool = False) -> None:
        out.append((f"{eco}::{name}", name, str(version or ""), eco, dev, path))

    def version(v: object) -> object:
        return v.get("version", "") if isinstance(v, dict) else v

    try:
        if base == "package.json":
            doc = json.loads(content)
            for key, dev in (("dependencies", False), ("devDependencies", True)):
                for k, v in (doc.get(key) or {}).items():
                    add("npm", k, v, dev)
        elif base == "composer.json":
            doc = json.loads(content)
            for key, dev in (("require", False), ("require-dev", True)):
                for k, v in (doc.get(key) or {}).items():
                    add("packagist", k, v, dev)
        elif base == "Cargo.toml":
            doc = tomllib.loads(content)
            for key, dev in (("dependencies", False), ("dev-dependencies", True), ("build-dependencies", True)):
                for k, v in (doc.get(key) or {}).items():
                    add("cargo", k, version(v), dev)
        elif base == "pyproject.toml":
            doc = tomllib.loads(content)
            for line in doc.get("project", {}).get("dependencies", []):
                m = re.match(r"([\w.-]+)(?:\[[^\]]*\])?\s*(.*)", line)
                add("pypi", m[1], m[2])
            for k, v in doc.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
                if k != "python":
                    add("pypi", k, version(v))
        elif re.fullmatch(r"requirements.*\.txt", base):
            for line in content.splitlines():
                m = re.match(r"\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*([=<>!~][^;#]*)?", line)
                if m:
                    add("pypi", m[1], (m[2] or "").strip(), "dev" in base)
        elif base == "go.mod":
            for m in re.finditer(r"^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v[\w.+-]+)", content, re.M):
                add("go", m[1], m[2])
        elif base == "Gemfile":
            for m in re.finditer(r"^\s*gem\s+[\"']([^\"']+)[\"'](?:\s*,\s*[\"']([^\"']+)[\"'])?", content, re.M):
                add("rubygems", m[1], m[2])
        elif base == "pom.xml":
            for m in re.finditer(r"<dependency>(.*?)</dependency>", content, re.S):
                get = lambda tag, text=m[1]: (re.search(rf"<{tag}>\s*([^<]*?)\s*</{tag}>", text) or [None, ""])[1]
                add("maven", f"{get('groupId')}:{get('artifactId')}", get("version"), get("scope") == "test")
        elif base in ("build.gradle", "build.gradle.kts"):
            for m in re.finditer(r"(\w*[iI]mplementation|api|compileOnly|runtimeOnly)\s*\(?\s*[\"']([^:\"']+:[^:\"']+):([^\"']+)[\"']", content):
                add("maven", m[2], m[3], m[1].startswith("test"))
        elif base.endswith(".csproj"):
            for m in re.finditer(r"<PackageReference\s+Include=\"([^\"]+)\"(?:\s+Version=\"([^\"]+)\")?", content):
                add("nuget", m[1], m[2])
        elif base == "pubspec.yaml":
            part, dev = None, False
            for line in content.splitlines():
                if re.match(r"\w", line):
                    part, dev = line.split(":")[0], line.startswith("dev_")
                elif part in ("dependencies", "dev_dependencies") and (m := re.match(r"  ([\w-]+):\s*(\S*)", line)):
                    add("pub", m[1], m[2], dev)
        elif base == "mix.exs":
            for m in re.finditer(r"\{:(\w+),\s*\"([^\"]+)\"([^}]*)\}", content):
                add("hex", m[1], m[2], "only: :dev" in m[3] or "only: :test" in m[3])
    except (ValueError, AttributeError, TypeError):
        return []
    return out


def dependencies(files: DataFrame) -> DataFrame:
    """Dependency rows of the manifests among files(path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, content in zip(batch["path"], batch["content"]) if path and content for r in dependencies_of(path, content)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DEPENDENCIES.split(", ")])

    return files.select("path", "content").mapInPandas(run, DEPENDENCIES)
