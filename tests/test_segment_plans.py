"""Queries over lines shuffle them once: what a document needs is found by windows of one order and one aggregate, without joins."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import runs
from corpusloom.operators import markdown, sections
from corpusloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["structural_units", "template_clauses", "text_markdown"])
def test_lines_are_shuffled_once(spark, query):
    plan = catalog.QUERIES[query](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    executed = catalog.QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1


def test_runs(spark):
    made = runs(F.col("x"), lambda v: v > 5)
    df = spark.createDataFrame([([1, 7, 2, 3, 8, 9],), ([6],), ([],), (None,)], "x array<int>").select(made.alias("r"))
    assert [r.r for r in df.collect()] == [[[1], [7, 2, 3], [8], [9]], [[6]], [], None]


def test_templates_with_short_clauses_only(spark):
    """A text all of whose clauses are too short stands whole, under its title; one with a long one has only that."""
    rows = [(1, 1, "通用条款"), (1, 2, "第一条 a"), (1, 3, "专用条款"), (1, 4, "1. b"), (2, 1, "第一条 a"), (2, 2, "第二条 长长长长"), (None, 1, " x ")]
    df = spark.createDataFrame(rows, "doc int, pos int, line string").withColumn("title", F.when(F.col("doc") == 1, "某"))
    got = sections.template_rows(df, "doc", "pos", "line", F.col("title")).collect()
    assert sorted(((r.doc, r.nth, r.number, r.title, r.section_path, r.text) for r in got), key=str) == [
        (1, 1, "", "某", "未编号文本", "通用条款\n第一条 a\n专用条款\n1. b"),
        (2, 1, "第二条", "长长长长", "合同正文", "第二条 长长长长"),
        (None, 1, "", "未编号文本", "未编号文本", "x"),
    ]


def test_contents_that_repeat_an_entry(spark):
    """An entry that comes again in its own table or line ends it; one of an earlier table doesn't, nor does a heading after a line between."""
    docs = ["目录|第一章 甲|第二章 乙|目录|第一章 甲|第三章 丙|第一章 甲|丁", "目录|第一章 甲第一章 甲|第二章 乙", "目录|文|第一章 甲|第一章 甲"]
    rows = [(k, n, x) for k, d in enumerate(docs) for n, x in enumerate(d.split("|"))]
    got = {r.doc: r.markdown.split("\n\n") for r in markdown.documents(spark.createDataFrame(rows, "doc int, pos int, line string"), "doc", "pos", "line").collect()}
    assert got == {
        0: ["## 目录", "- 第一章 甲\n- 第二章 乙", "## 目录", "- 第一章 甲\n- 第三章 丙", "## 第一章　甲", "丁"],
        1: ["## 目录", "## 第一章　甲第一章 甲", "## 第二章　乙"],
        2: ["## 目录", "文", "## 第一章　甲", "## 第一章　甲"],
    }


def test_long_last_lines_stay_whole(spark):
    """Sentences of a long line go to a table only if one follows: before, an article's or a text's last ones were lost or went on to the next unit."""
    long = "长" * 300 + "。" + "末句。"
    rows = [(1, k, x) for k, x in enumerate(["## 第一章 x", "**第一条** " + long, "**第二条** 乙", "## 第二章 y", long])]
    got = sections.structural_units(spark.createDataFrame(rows, "doc int, pos int, line string"), "doc", "pos", "line").orderBy("nth").collect()
    assert [(r.type, r.path, r.body) for r in got] == [("article", "第一章 x", "**第一条** " + long), ("article", "第一章 x", "**第二条** 乙"), ("section_text", "第二章 y", long)]


def test_paths_after_contents_and_empty_headings(spark):
    """A table of contents' heading isn't counted among those that paths are looked up by."""
    rows = [(1, k, x) for k, x in enumerate(["## 第一章 x", "甲", "## 目 录", "第二章 在目录", "### 第二章 y", "乙"])]
    got = sections.structural_units(spark.createDataFrame(rows, "doc int, pos int, line string"), "doc", "pos", "line").orderBy("nth").collect()
    assert [(r.nth, r.path, r.body) for r in got] == [(1, "第一章 x", "甲"), (2, "第二章 y", "乙")]
