"""Text to Markdown: tables of contents, torn articles, blanks to fill in, odd documents."""

from corpusloom.operators import markdown


def shown(spark, *docs):
    rows = [(k, n, x) for k, lines in enumerate(docs) for n, x in enumerate(lines)]
    got = markdown.documents(spark.createDataFrame(rows, "doc int, pos int, line string"), "doc", "pos", "line").collect()
    by = {r["doc"]: r["markdown"].split("\n\n") for r in got}
    return [by.get(k) for k in range(len(docs))]


def test_contents_become_headings(spark):
    """The table ends where an entry comes again, or at a line that is none; what it named is a heading in the body."""
    first = ["目  录", "第一章 总则 3", "附件一", "第一章 总则", "第一条　甲", "附件一", "乙"]
    second = ["前文", "目录", "第一章 总则第二章 分则", "这一行不是目录中的条目。", "第二章 分则"]
    assert shown(spark, first, second) == [
        ["## 目录", "- 第一章 总则\n- 附件一", "## 第一章　总则", "**第一条**　甲", "## 附件一", "乙"],
        ["前文", "## 目录", "- 第一章 总则\n- 第二章 分则", "这一行不是目录中的条目。", "## 第二章　分则"],
    ]


def test_levels_by_the_ranks_that_occur(spark):
    a, b = shown(spark, ["第一编 甲", "第一章 乙", "第一节 丙", "通用条款"], ["第一节 甲"])
    assert a == ["## 第一编　甲", "### 第一章　乙", "#### 第一节　丙", "## 通用条款"] and b == ["## 第一节　甲"]


def test_torn_articles_and_blanks(spark):
    a, b, c = shown(spark, ["第一条", "17", "甲", "___；", "___。", "第二条"], ["第一条", "第二条", "第三条", "丙"], ["第一章 甲", "____", "____", "| a |", "____"])
    assert a == ["**第一条**　甲___；___。", "**第二条**"]
    assert b == ["**第一条**　第二条", "**第三条**　丙"]
    assert c == ["## 第一章　甲", "________", "| a |", "____"]


def test_a_number_before_contents_stays(spark):
    assert shown(spark, ["第一条", "目录", "第一章 甲"]) == [["**第一条**", "## 目录", "- 第一章 甲"]]


def test_odd_documents(spark):
    """No lines, null and blank ones, repeated positions' texts, a null key, clashing columns."""
    df = spark.createDataFrame([(None, 1, "甲"), (None, 2, None), (3, 1, "  "), (4, 1, "第一条" + "长" * 100_000)], "doc int, pos int, line string").selectExpr("*", "1 as t", "2 as kind", "3 as table")
    got = {r["doc"]: len(r["markdown"]) for r in markdown.documents(df, "doc", "pos", "line").collect()}
    assert got == {None: 1, 4: 100_008}
    assert markdown.documents(df.limit(0), "doc", "pos", "line").count() == 0
