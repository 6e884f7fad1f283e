"""HTML and DOCX to text.

Tag stripping and link extraction are expressions. The longest container needs the element tree, and DOCX its zip: both are Arrow-batched
maps with the standard library's parsers, row by row, without a shuffle.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose text is no content, and elements that end a line.
SKIPPED = ("script", "style", "nav", "header", "footer", "aside", "form")
BREAKS = ("br", "p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6")
CONTAINERS = ("article", "main", "section", "div", "td", "body")


def plain(html: Column) -> Column:
    """Text of HTML: script and style out, br and block ends as line ends, tags out, common entities back, blanks folded."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.regexp_replace(t, r"[ \t\r]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{2,}|^\s+|\s+$", "\n")


def links(html: Column) -> Column:
    """Distinct targets of a page's links, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<a\b[^>]*?href\s*=\s*["']([^"'#]+)["']"""), F.lit(1)))


def anchors(html: Column) -> Column:
    """A page's links in order, repeated ones too, as (href, title): what stands in the element, without tags, blanks folded."""
    pattern, text = r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"'#]+)["'][^>]*>(.*?)</a>""", F.coalesce(html, F.lit(""))
    group = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    return F.zip_with(group(1), group(2), lambda href, inner: F.struct(href.alias("href"), F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", " "), r"\s+", " ")).alias("title")))


def absolute(base: Column, link: Column) -> Column:
    """A link as an absolute URL: with its scheme as it is, from the host, or from the page's folder."""
    host = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1)
    folder = F.regexp_replace(base, r"(?<=[^/:])/[^/]*$", "/")
    return F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), link)).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(F.regexp_replace(folder, "([^/])$", "$1/"), link))


class _Containers(HTMLParser):
    """Keeps a page's text in pieces, and where containers that closed begin and end in it; those within another one are dropped.

    A container's text is never longer than that of one around it, so each piece is joined once, however deep containers nest.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.skip = 0
        self.pieces: list[str] = []
        self.closed: list[tuple[int, int]] = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BREAKS:
            self.handle_data("\n")
        if tag in CONTAINERS:
            self.open.append((tag, len(self.pieces)))

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag in CONTAINERS and any(t == tag for t, _ in self.open):
            while self.open:
                name, start = self.open.pop()
                if name != "body":
                    while self.closed and self.closed[-1][0] >= start:
                        self.closed.pop()
                    self.closed.append((start, len(self.pieces)))
                if name == tag:
                    break

    def handle_data(self, data):
        if not self.skip:
            self.pieces.append(data)

    def text(self, start: int = 0, end: int | None = None) -> str:
        return tidy("".join(self.pieces[start:end]))


def tidy(text: str) -> str:
    return "\n".join(line for line in (" ".join(x.split()) for x in text.split("\n")) if line)


def main_text(html: str | None, least: int = 200) -> str:
    """The longest container's text, or the whole page's if that has fewer than ``least`` characters."""
    parser = _Containers()
    parser.feed(html or "")
    parser.close()
    texts = [parser.text(*span) for span in parser.closed]
    if len(parser.open) > 1:  # of containers that were never closed, the outermost
        texts.append(parser.text(parser.open[0][1]))
    best = max(texts, key=len, default="")
    return best if len(best) >= least else parser.text()


def with_main_text(pages: DataFrame, html: str = "html", least: int = 200) -> DataFrame:
    """pages with main_text."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda h: main_text(h, least))

    return pages.withColumn("main_text", run(html))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes) -> list[tuple[str, str]]:
    """(kind, text) of a DOCX body in order: paragraphs with tabs and breaks, tables as rows of cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(node) -> str:
        out = []
        for x in node.iter():
            out.append({f"{_W}t": x.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(x.tag, ""))
        return "".join(out)

    blocks = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p" and text(node).strip():
            blocks.append(("paragraph", text(node).strip()))
        elif node.tag == f"{_W}tbl":
            rows = [[" ".join(text(c).split()) for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            blocks.append(("table", "\n".join("| " + " | ".join(r) + " |" for r in rows)))
    return blocks


def docx_rows(files: DataFrame) -> DataFrame:
    """(path, pos, kind, text) of files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, n, k, t) for p, c in zip(f["path"], f["content"]) for n, (k, t) in enumerate(docx_blocks(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "pos", "kind", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, pos long, kind string, text string")


def table_markdown(rows: list[list[str]], most_columns: int = 6, least_full: float = 0.5) -> str:
    """A table as Markdown without empty rows and columns; wide and sparse ones as lines of text."""
    rows = [[(c or "").strip() for c in r] for r in rows if any((c or "").strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    used = [k for k in range(width) if any(r[k] for r in rows)]
    rows = [[r[k] for k in used] for r in rows]
    full = sum(bool(c) for r in rows for c in r) / (len(rows) * len(used))
    if len(used) > most_columns and full < least_full:
        return "\n".join(" ".join(c for c in r if c) for r in rows)
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * len(used), *lines[1:]])
