"""Documents: text of common formats, chunks bounded by headings and size, links between documents."""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKDOWN_LINK = r"\[[^\]]*\]\(([^)]+)\)"
HTML_LINK = "<a\\s[^>]*href=[\"']([^\"']+)[\"']"
HEADING = re.compile(r"^(#{1,6})[ \t]+(.+)$|^([^\n]+)\n[=\-]{3,}$", re.M)


def _xml_text(raw: bytes, breaks: str) -> str:
    text = re.sub(breaks, "\n", raw.decode("utf-8", "replace"))
    return html.unescape(re.sub(r"<[^>]+>", "", text)).strip()


def _sheets(z: zipfile.ZipFile) -> str:
    names = z.namelist()
    shared = [_xml_text(m.encode(), r"</si>") for m in re.findall(r"<si>.*?</si>", z.read("xl/sharedStrings.xml").decode(), re.S)] if "xl/sharedStrings.xml" in names else []
    rows = []
    for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        for row in re.findall(r"<row\b.*?</row>", z.read(name).decode("utf-8", "replace"), re.S):
            cells = re.findall(r"<c\b([^>]*?)(?:/>|>(.*?)</c>)", row, re.S)
            values = []
            for attributes, inner in cells:
                m = re.search(r"<v>(.*?)</v>", inner or "", re.S)
                value = m[1] if m else _xml_text((inner or "").encode(), "$^")
                values.append(shared[int(value)] if m and 't="s"' in attributes and int(value) < len(shared) else html.unescape(value))
            rows.append("\t".join(values))
    return "\n".join(rows)


def document_text(path: str, content: bytes) -> str | None:
    """Text of a document by its extension; null for unknown or damaged ones."""
    kind = path.rpartition(".")[2].lower()
    try:
        if kind in ("docx", "pptx", "xlsx"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if kind == "docx":
                    return _xml_text(z.read("word/document.xml"), r"</w:p>|<w:br/>")
                if kind == "xlsx":
                    return _sheets(z)
                number = lambda n: int(re.search(r"\d+", n.rpartition("/")[2])[0])
                slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
                return "\n\n".join(_xml_text(z.read(n), r"</a:p>") for n in slides)
        text = content.decode("utf-8", "replace")
        if kind in ("html", "htm"):
            return re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", text)).strip()
        if kind == "xml":
            return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", text))).strip()
        if kind == "rtf":
            text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
            text = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
            return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", re.sub(r"\\par[d]?\b ?", "\n", text))).strip()
        return text if kind in ("md", "txt", "rst", "adoc", "org", "csv", "tex", "log") else None
    except (zipfile.BadZipFile, KeyError, UnicodeDecodeError, ValueError):
        return None


def texts(files: DataFrame) -> DataFrame:
    """(path, text) of files(path, content binary) whose format is known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [document_text(p, bytes(c)) if c is not None else None for p, c in zip(batch["path"], batch["content"])]})

    return files.select("path", "content").mapInPandas(run, "path string, text string").where("text is not null")


def _windows(words: list[str], size: int, overlap: int) -> Iterator[str]:
    at = 0
    while True:
        yield " ".join(words[at : at + size])
        if at + size >= len(words):
            return
        at += size - overlap


def _inferred(text: str) -> str:
    first = text.split("\n", 1)[0].strip()
    return first if first and len(first.split()) <= 10 and first[-1] not in ".," else ""


def chunk_text(text: str, size: int = 512, overlap: int = 64) -> list[tuple[str, str, int, int]]:
    """(heading, text, start, end) chunks: sections under headings, else packed paragraphs, else windows; offsets in code points."""
    out, heads = [], list(HEADING.finditer(text))
    if heads:
        cuts = [m.start() for m in heads] + [len(text)]
        sections = ([("", 0, cuts[0])] if text[: cuts[0]].strip() else []) + [((m[2] or m[3]).strip(), a, b) for m, a, b in zip(heads, cuts, cuts[1:])]
        for heading, a, b in sections:
            body = text[a:b].strip()
            words = body.split()
            if words:
                out += [(heading, body, a, b)] if len(words) <= size else [(heading, w, a, b) for w in _windows(words, size, overlap)]
        return out
    paragraphs = [(m.start(), m[0].strip()) for m in re.finditer(r"(?:(?!\n\n).)+", text, re.S) if m[0].strip()]
    if len(paragraphs) <= 1:
        words = text.split()
        return [(_inferred(w), w, 0, len(text)) for w in _windows(words, size, overlap)] if words else []
    held, count = [], 0

    def flush():
        nonlocal held, count
        if held:
            body = "\n\n".join(p for _, p in held)
            out.append((_inferred(body), body, held[0][0], held[-1][0] + len(held[-1][1])))
        held, count = [], 0

    for at, p in paragraphs:
        n = len(p.split())
        if held and count + n > size:
            flush()
        if n > size:
            out.extend((_inferred(p), w, at, at + len(p)) for w in _windows(p.split(), size, overlap))
        else:
            held.append((at, p))
            count += n
    flush()
    return out


def chunks(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(id, doc_file, idx, heading, text, start_offset, end_offset, content_hash) of docs(path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f"{p}::chunk_{k}", p, k, *c) for p, t in zip(batch["path"], batch["text"]) if t for k, c in enumerate(chunk_text(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["id", "doc_file", "idx", "heading", "text", "start_offset", "end_offset"])

    rows = docs.select("path", "text").mapInPandas(run, "id string, doc_file string, idx long, heading string, text string, start_offset long, end_offset long")
    return rows.withColumn("content_hash", F.sha2("text", 256))


def link_type(url: Column) -> Column:
    return F.when(url.rlike("/wiki/|confluence|atlassian"), "confluence").when(url.rlike("/browse/|jira"), "jira").when(url.rlike("^(https?:)?//"), "external").otherwise("local")


def document_links(docs: DataFrame) -> DataFrame:
    """(src, url, link_type, dst) of Markdown and HTML links of docs(path, text); local targets are resolved against the folder."""

    @F.pandas_udf("string")
    def resolve(path: pd.Series, url: pd.Series) -> pd.Series:
        clean = url.str.replace(r"[?#].*$", "", regex=True)
        return pd.Series([posixpath.normpath(posixpath.join(posixpath.dirname(p), u) if not u.startswith("/") else u.lstrip("/")) if u else None for p, u in zip(path, clean)])

    url = F.explode(F.concat(F.regexp_extract_all("text", F.lit(MARKDOWN_LINK), F.lit(1)), F.regexp_extract_all("text", F.lit(HTML_LINK), F.lit(1))))
    found = docs.select(F.col("path").alias("src"), url.alias("url")).where("not startswith(url, '#')").withColumn("link_type", link_type(F.col("url")))
    return found.withColumn("dst", F.when(F.col("link_type") == "local", resolve("src", "url")))


def link_edges(docs: DataFrame) -> DataFrame:
    """LINKS_TO edges (src, dst, url, link_type) whose target is an indexed document and not the source itself."""
    known = docs.select(F.col("path").alias("dst")).distinct()
    return document_links(docs).where("dst is not null and src <> dst").join(known, "dst", "left_semi").select("src", "dst", "url", "link_type").distinct()
