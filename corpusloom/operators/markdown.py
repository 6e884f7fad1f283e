"""Plain and scanned text to Markdown: a first pass reads tables of contents and which ranks of headings occur, a second one the body.

All of it is windows over line rows, a document being one window.

* A line that says 目录 begins a table of contents. Its entries are the headings that follow, several of which may stand in one line; it ends
  at the first line that is none, or that repeats an entry, which is where the body begins.
* Headings are 编, 章, 节 and the like, each rank that occurs one level deeper, the usual names of a contract's parts, and lines that
  repeat an entry of a table of contents.
* An article's number that stands alone is joined with the line after it. Lines that go on with a blank to be filled in are joined with what
  they go on. Numbers that stand alone (of pages) go.

Null and blank lines go; a document without any other has no row. Equal lines are lines of their own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpusloom.functions.text import not_blank, strip

# How headings of each rank, of a contract's parts, articles and page numbers read.
_COUNT = "[一二三四五六七八九十百千万零〇0-9]+"
_RANKS = (f"^第{_COUNT}编", f"^第{_COUNT}(?:章|篇|部分)", f"^第{_COUNT}节")
_PARTS = r"^(使用说明|说\s*明|合同协议书|协议书|通用合同条款|通用条款|专用合同条款|专用条款|附\s*[件录]\s*[一二三四五六七八九十0-9]*\s*[:：]?.*|签署页|填写说明|重要提示|(?:专业)?(?:术语|名词)解释|前\s*言)$"
_ARTICLE, _ALONE, _PAGE, _CONTENTS = rf"^(第{_COUNT}条)[\s　]*(.*)$", rf"^第{_COUNT}条$", r"^[-—\s]*\d{1,4}[-—\s]*$", r"^目[\s　]*录$"
_NUMBER = rf"^(第{_COUNT}(?:编|章|篇|部分|节))[\s　]*(.*)$"
#: What stands between a heading's number and its text.
_GAP = "　"
_TITLE = 60


def _rank(line: Column) -> Column:
    """1 to 3 for a numbered heading, 0 for a part's usual name, null for other lines; a long line is no heading."""
    out = F.when(line.rlike(_PARTS), 0)
    for n, pattern in enumerate(_RANKS, 1):
        out = out.when(line.rlike(pattern), n)
    return F.when(F.length(line) <= _TITLE, out)


def _entries(line: Column) -> Column:
    """The headings that one line of a table of contents names, without leaders and page numbers."""
    parts = F.split(line, f"(?=第{_COUNT}[编章节篇])")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(strip(x), r"[\s.…·]*\d*$", "")), lambda x: x != "")


def _orders(key: str, *more: str) -> tuple[WindowSpec, WindowSpec, WindowSpec, WindowSpec]:
    """The one order that windows have, then up to the row before, up to the row, and over all rows of a document; so lines are sorted once."""
    in_order = Window.partitionBy(key).orderBy("pos", "t", *more)
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    return in_order, in_order.rowsBetween(first, -1), in_order.rowsBetween(first, Window.currentRow), in_order.rowsBetween(first, last)


def contents(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Lines (key, pos, t, rank) with ``toc``: title, entry or null for the body; and ``entries``, those that a heading would be in a table."""
    given = lines.select(key, F.col(order).alias("pos"), F.col(line).alias("given")).filter(not_blank(F.col("given")))
    rows = given.select(key, "pos", strip(F.col("given")).alias("t"))
    rows = rows.withColumn("title", F.col("t").rlike(_CONTENTS)).withColumn("rank", _rank(F.col("t")))
    rows = rows.withColumn("entries", F.when(F.col("rank").isNotNull() & ~F.col("title"), _entries(F.col("t"))))
    each = rows.select("*", F.posexplode_outer("entries").alias("k", "entry"))
    each = each.withColumn("earlier", F.lag("pos").over(Window.partitionBy(key, "entry").orderBy("pos", "t", "k")))
    # only headings right after a title are a table's, up to the first that repeats an entry
    _, _, upto, _ = _orders(key, "k")
    each = each.withColumn("since", F.last(F.when(F.col("title"), F.col("pos")), True).over(upto))
    again = F.coalesce(F.col("entry").isNotNull() & (F.col("earlier") >= F.col("since")), F.lit(False))
    ended = F.when(F.col("title"), False).when(F.col("rank").isNull() | again, True)
    each = each.withColumn("body", F.coalesce(F.last(ended, True).over(upto), F.lit(False)))
    # of a line that names several entries the last one has seen them all
    rows = each.filter("k is null or k = size(entries) - 1")
    toc = F.when(F.col("title"), "title").when(F.col("since").isNotNull() & ~F.col("body"), "entry")
    return rows.select(key, "pos", "t", "k", "rank", toc.alias("toc"), "entries")


def _shown(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, n, kind, shown, joins): lines in Markdown, and whether each goes on with the block before."""
    in_order, before, _, whole = _orders(key, "k")
    rows = contents(lines, key, order, line).filter(F.col("toc").isNotNull() | ~F.col("t").rlike(_PAGE))
    # an article's number alone is joined with what follows; of several in a row each second one is what follows
    rows = rows.withColumn("alone", F.col("toc").isNull() & F.col("t").rlike(_ALONE)).withColumn("n", F.row_number().over(in_order))
    follows = F.lead("toc").over(in_order).isNull() & F.lead("pos").over(in_order).isNotNull()
    other = F.coalesce(F.last(F.when(~F.col("alone"), F.col("n")), True).over(before), F.lit(0))
    rows = rows.withColumn("opens", F.col("alone") & follows & ((F.col("n") - other) % 2 == 1))
    torn = F.when(F.lag("opens").over(in_order), F.lag("t").over(in_order))
    rows = rows.withColumn("torn", torn).withColumn("x", F.when(F.col("torn").isNotNull(), F.concat("torn", F.lit(" "), "t")).otherwise(F.col("t"))).filter("not opens")
    # the headings' dictionary: entries of the document's tables of contents, and the ranks that its body has
    rows = rows.withColumn("names", F.flatten(F.collect_set(F.when(F.col("toc") == "entry", F.col("entries"))).over(whole)))
    own = F.when(F.col("torn").isNull(), F.col("rank"))
    rows = rows.withColumn("rank", F.when(F.col("toc").isNull(), F.coalesce(own, F.when(F.array_contains("names", F.col("x")), 0)))).drop("names")
    kind = F.when(F.col("toc") == "entry", "contents").when((F.col("toc") == "title") | F.col("rank").isNotNull(), "heading").when(F.col("x").rlike(_ARTICLE), "article").otherwise("text")
    rows = rows.withColumn("kind", kind)
    above = lambda r: F.when((F.col("rank") > r) & F.max(F.col("rank") == r).over(whole), 1).otherwise(0)
    goes_on = (F.col("kind") == "text") & F.col("x").startswith("_") & F.lag("kind").over(in_order).isin("text", "article") & ~F.lag("x").over(in_order).startswith("|")
    joins = F.coalesce(goes_on | ((F.col("kind") == "contents") & (F.lag("kind").over(in_order) == "contents")), F.lit(False))
    rows = rows.withColumn("level", F.lit(2) + above(1) + above(2)).withColumn("joins", joins)
    spaced = lambda pattern, mark: F.concat(F.lit(mark), F.regexp_extract("x", pattern, 1), F.lit(mark), F.when(F.regexp_extract("x", pattern, 2) != "", F.concat(F.lit(_GAP), F.regexp_extract("x", pattern, 2))).otherwise(""))
    heading = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.when(F.col("x").rlike(_NUMBER), spaced(_NUMBER, "")).otherwise(F.col("x")))
    listed = F.array_join(F.transform("entries", lambda e: F.concat(F.lit("- "), e)), "\n")
    shown = F.when(F.col("kind") == "contents", listed).when(F.col("toc") == "title", "## 目录").when(F.col("kind") == "heading", heading).when(F.col("kind") == "article", spaced(_ARTICLE, "**")).otherwise(F.col("x"))
    return rows.select(key, "n", "kind", shown.alias("shown"), "joins")


def blocks(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, nth, kind, text): the blocks of each document in Markdown: heading, contents, article, text."""
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _shown(lines, key, order, line).withColumn("nth", F.sum((~F.col("joins")).cast("int")).over(upto))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "shown"))), lambda x: x["shown"])
    found = rows.groupBy(key, "nth").agg(F.min_by("kind", "n").alias("kind"), parts.alias("parts"))
    return found.select(key, "nth", "kind", F.when(F.col("kind") == "contents", F.array_join("parts", "\n")).otherwise(F.array_join("parts", "")).alias("text"))


def documents(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, markdown): each document's blocks, a blank line between them."""
    rows = _shown(lines, key, order, line)
    gap = F.when(~F.col("joins"), "\n\n").when(F.col("kind") == "contents", "\n").otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("n", F.concat(gap, "shown").alias("part"))))
    return rows.groupBy(key).agg(F.substring(F.array_join(F.transform(parts, lambda x: x["part"]), ""), 3, (1 << 31) - 1).alias("markdown"))
