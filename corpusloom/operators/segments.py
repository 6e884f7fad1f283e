"""Structure of documents as rows: lines, headings, articles, clauses, sections.

Segmentation is expressed with windows over (document, line), so it needs one shuffle by document. A document is the largest unit
that one task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_line, text_of
from corpusloom.operators.windows import segments

#: How an article, a numeric outline item and a Markdown heading begin.
ARTICLE = r"^第[零〇一二两三四五六七八九十百千万\d]+条"
OUTLINE = r"^(?:[一二三四五六七八九十]+、|\d+[.、)]|[（(][一二三四五六七八九十\d]+[)）])"
HEADING = r"^(#{1,6})\s+(.*)$"


def line_rows(docs: DataFrame, key: str, text: str, mark: str = "\n") -> DataFrame:
    """(key, pos, line) of every non-empty line, cleaned."""
    rows = docs.select(key, F.posexplode(F.split(text_of(F.col(text)), mark)).alias("pos", "line"))
    return rows.withColumn("line", clean_line(F.col("line"))).filter("line != ''")


def heading_level(line: Column) -> Column:
    """1 to 6 for Markdown headings, 1 to 4 for part, chapter, section and article lines, else null."""
    hashes = F.length(F.regexp_extract(line, HEADING, 1))
    named = F.regexp_extract(line, r"^第[零〇一二两三四五六七八九十百千万\d]+([编章节])", 1)
    return F.when(hashes > 0, hashes).when(named == "编", 1).when(named == "章", 2).when(named == "节", 3)


def sections(docs: DataFrame, key: str, text: str, starts: str, mark: str = "\n") -> DataFrame:
    """(key, segment, title, body, n_lines): a segment begins at each line that matches ``starts``; what is before is segment 0."""
    rows = segments(line_rows(docs, key, text), key, "pos", F.col("line").rlike(starts))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return rows.groupBy(key, "segment").agg(F.min_by("line", "pos").alias("title"), F.array_join(parts, mark).alias("body"), F.count(F.lit(1)).alias("n_lines"))


def articles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Articles of statutes with part, chapter and section; lines joined by spaces; what is before the first article is dropped."""
    rows = line_rows(docs, key, text).withColumn("level", heading_level(F.col("line")))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = lambda c: F.last(c, ignorenulls=True).over(w)
    at = lambda n: F.when(F.col("level") == n, F.struct("pos", "line"))
    rows = rows.withColumn("p1", upto(at(1))).withColumn("p2", upto(at(2))).withColumn("p3", upto(at(3)))
    rows = rows.withColumn("p2", F.when(F.col("p1").isNull() | (F.col("p2.pos") > F.col("p1.pos")), F.col("p2")))
    rows = rows.withColumn("p3", F.when(F.col("p3.pos") > F.coalesce(F.greatest("p1.pos", "p2.pos"), F.lit(-1)), F.col("p3")))
    rows = segments(rows.filter("level is null"), key, "pos", F.col("line").rlike(ARTICLE)).filter("segment > 0")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return rows.groupBy(key, "segment").agg(
        F.regexp_extract(F.min_by("line", "pos"), ARTICLE, 0).alias("article_no"),
        F.array_join(parts, " ").alias("body"),
        *(F.min_by(F.col(f"{c}.line"), "pos").alias(n) for c, n in (("p1", "part"), ("p2", "chapter"), ("p3", "section"))),
    )


def clauses(docs: DataFrame, key: str, text: str, outline_too: bool = False, title_chars: int = 30) -> DataFrame:
    """Contract clauses: articles, then outline items, then headings begin one; after the first article, outline items stay inside."""
    rows = line_rows(docs, key, text)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    art, out, head = (F.col("line").rlike(p) for p in (ARTICLE, OUTLINE, HEADING))
    rows = rows.withColumn("sticky", F.coalesce(F.max(art).over(w), F.lit(False)))
    starts = art | head | (out & (F.lit(outline_too) | ~F.col("sticky")))
    rows = segments(rows.withColumn("starts", starts), key, "pos", F.col("starts"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    found = rows.groupBy(key, "segment").agg(F.min_by("line", "pos").alias("first"), F.array_join(parts, "\n").alias("body"))
    return found.select(key, F.col("segment"), F.left(F.col("first"), F.lit(title_chars)).alias("title"), "body")


def markdown_fields(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fields): ``## name`` sections of a document as a map; a repeated name keeps its first section."""
    rows = sections(docs, key, text, r"^##\s")
    rows = rows.filter("segment > 0").withColumn("name", F.regexp_replace("title", r"^##\s+", "")).withColumn("value", F.trim(F.regexp_replace("body", r"^##[^\n]*\n?", "")))
    firsts = rows.groupBy(key, "name").agg(F.min_by("value", "segment").alias("value"))
    return firsts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("fields"))


def outline(chunks: DataFrame, key: str, order: str, label: Column, most: int = 120) -> DataFrame:
    """Distinct labels of a document's chunks in order, ``most`` at most, with a last one that says how many there are."""
    items = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), label.alias("label")))), lambda x: x["label"]))
    out = chunks.groupBy(key).agg(items.alias("outline"))
    more = F.concat(F.slice("outline", 1, most), F.array(F.format_string("(%d in all)", F.size("outline"))))
    return out.withColumn("outline", F.when(F.size("outline") > most, more).otherwise(F.col("outline")))
