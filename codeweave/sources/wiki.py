"""Wiki pages: storage HTML to Markdown, crawling by links with a cap, and synchronisation with what is stored."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.session import materialize


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.href, self.code, self.cells = "", False, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "table", "ac:structured-macro"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}." if self.lists[-1][0] == "ol" else "-"
            self.out.append("\n" + "  " * (len(self.lists) - 1) + mark + " ")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag in ("pre", "ac:plain-text-body"):
            self.code = True
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.code:
            self.out.append("`")
        elif tag == "a":
            self.href = dict(attrs).get("href") or ""
            self.out.append("[")
        elif tag == "tr":
            self.cells = 0
            self.out.append("\n|")
        elif tag in ("td", "th"):
            self.cells += 1
            self.out.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag in ("pre", "ac:plain-text-body"):
            self.code = False
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.code:
            self.out.append("`")
        elif tag == "a":
            self.out.append(f"]({self.href})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" |")

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.out.append(data[6:])

    def handle_data(self, data: str) -> None:
        self.out.append(data if self.code else " ".join(data.split()).join((" " if data[:1].isspace() else "", " " if data[-1:].isspace() else "")) if data.strip() else " " if self.out and not self.out[-1].endswith(("\n", " ")) else "")


def markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    lines = [x.rstrip() for x in "".join(parser.out).split("\n")]
    kept = [x for i, x in enumerate(lines) if x or (i and lines[i - 1])]
    return "\n".join(kept).strip()


def pages_as_markdown(pages: DataFrame) -> DataFrame:
    """pages(id, html, ...) with the column text; other columns stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[markdown(h) for h in batch["html"]])

    return pages.mapInPandas(run, f"{pages.schema.simpleString()[7:-1].replace(':', ' ')}, text string")


def crawl(start: DataFrame, links: DataFrame, spaces: DataFrame | None = None, depth: int = 3, most: int = 1000) -> DataFrame:
    """(id, level): pages reached from start(id) by links(src, dst) level by level, in spaces(id) only, until ``most`` pages."""
    seen = materialize(start.select("id").distinct().withColumn("level", F.lit(0)), "pages")
    frontier, count = seen, seen.count()
    for level in range(1, depth + 1):
        new = links.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        if spaces is not None:
            new = new.join(spaces.select("id"), "id", "left_semi")
        if count >= most:
            break
        new = materialize(new.orderBy("id").limit(most - count).withColumn("level", F.lit(level)), "pages")
        n = new.count()
        if not n:
            break
        count, seen, frontier = count + n, seen.unionByName(new), new
    return seen


def synchronised(stored: DataFrame, remote: DataFrame, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What to write and what to delete: remote(id, modified, ...) changed after the cursor or not stored(id, ...); stored ids that are gone."""
    missing = remote.join(stored.select("id"), "id", "left_anti")
    newer = remote.where(F.col("modified") > F.lit(since).cast("timestamp")).join(missing.select("id"), "id", "left_anti") if since else remote.join(missing.select("id"), "id", "left_anti")
    return missing.unionByName(newer), stored.select("id").join(remote.select("id"), "id", "left_anti")
