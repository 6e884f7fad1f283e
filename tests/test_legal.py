"""Legal texts, structure, traces and artifacts on small examples, with what is known or worked out by hand."""

import math
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import legal, messages, numerals, rules, text
from corpusloom.operators import artifacts, evaluation, joins, packing, retrieval, sections
from corpusloom.plans import catalog
from corpusloom.sources import html

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    """The value of an expression over one row."""
    cells = {k: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for k, v in values.items()}
    return spark.range(1).select(*(c.alias(k) for k, c in cells.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("title, cause", [
    ("王某诉吉林某景健身公司、张某娇等民间借贷纠纷案", "民间借贷纠纷"),
    ("顾某萍与王某宝等人民间借贷纠纷案", "民间借贷纠纷"),
    ("指导性案例279号：某模具公司诉广州沃某模具有限公司侵害计算机软件著作权纠纷案", "侵害计算机软件著作权纠纷"),
    ("荣某诉某汽车销售公司买卖合同纠纷案", "买卖合同纠纷"),
    ("某公司诉张某某等损害公司利益责任纠纷案", "损害公司利益责任纠纷"),
    ("", ""),
    (None, ""),
])
def test_cause_of_action(spark, title, cause):
    assert one(spark, legal.cause_of_action(F.col("t").cast("string"), ("民间借贷", "买卖合同", "买卖", "侵害计算机软件著作权")), t=title) == cause


@pytest.mark.parametrize("torn, whole", [("2011\n年\n11\n月\n21\n日", "2011年11月21日"), ("法释〔\n2012\n〕\n14\n号", "法释〔2012〕14号"), ("正文\n一", "正文\n一"), ("1\n \n2", "1\n \n2"), (None, "")])
def test_rejoin_numbers(spark, torn, whole):
    again = lambda c: legal.rejoin_numbers(legal.rejoin_numbers(c))
    assert one(spark, legal.rejoin_numbers(F.col("t").cast("string")), t=torn) == whole == one(spark, again(F.col("t").cast("string")), t=torn)


def test_numerals_by_grammar(spark):
    want = {"第五百三十三条": "533", "十二": "12", "一百零五": "105", "一万零二十": "10020", "十二万": "120000", "三千": "3000", "两百": "200", "五百三十三之一": "533之1", "abc": "abc"}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", numerals.article_key(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in rows} == want


def test_every_reason_occurs(spark):
    rows = catalog.QUERIES["rule_filter_reasons"](spark, SF).collect()
    seen = {x for r in rows for x in r["reasons"].split(",") if x}
    assert seen == {"too_short", "too_many_placeholders", "table_only", "signature_or_meta", "pure_definition_or_category", "no_meaningful_risk_dimension"}


def test_tight_text_is_made_once(spark):
    plan = catalog.QUERIES["rule_filter_reasons"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 4


@pytest.mark.parametrize("query, column, kinds", [
    ("verify_exact_fuzzy", "how", {"exact", "fuzzy", "none"}),
    ("verify_or_search", "status", {"exact", "semantic", "not_in_law", "not_in_store"}),
    ("dataset_merge", "origin", {"existing", "generated"}),
    ("second_pass", "decision", {"review", "review_drop", "include_main"}),
    ("structural_units", "type", {"article", "table"}),
    ("contract_blocks", "type", {"heading", "paragraph"}),
])
def test_every_branch_occurs(spark, query, column, kinds):
    assert {r[0] for r in catalog.QUERIES[query](spark, SF).select(column).distinct().collect()} == kinds


def test_all_kinds_of_citations(spark):
    """Names within each other, an ambiguous one, no law, and two laws of one article."""
    store = spark.createDataFrame([(1, "民法典合同编", "9"), (2, "民法典总则编", "9"), (3, "公司法", "3"), (4, "证券法", "8"), (5, "公司法", "7"), (6, "公司法实施办法", "7")], "chunk_id int, law string, article string").withColumn("article_text", F.lit("t"))
    cited = [(1, "民法典", "9", "none", None), (2, "民法典合同编的解释", "9", "fuzzy", 1), (3, "", "8", "fuzzy", 4), (4, "", "9", "none", None), (5, "公司", "3", "fuzzy", 3), (6, "公司法", "7", "exact", 5), (7, "公司法实施", "7", "none", None), (8, "x", "3", "none", None), (9, "公司法", "", "none", None)]
    got = joins.verify_citations(spark.createDataFrame([c[:3] for c in cited], "id int, law string, article string"), store).collect()
    assert sorted((r["id"], r["how"], r["chunk_id"]) for r in got) == [(c[0], c[3], c[4]) for c in cited]


def test_rounding_of_ratios(spark):
    """Half up on the shortest decimal: 1 / 2 000 000 reads as 0.0000005, and its binary value is a little less."""
    got = spark.range(1).select(evaluation.ratio(F.lit(1), F.lit(2_000_000)).alias("a"), evaluation.ratio(F.lit(1), F.lit(3)).alias("b")).first()
    assert (got["a"], round(1 / 2_000_000, 6)) == (0.000001, 0.0) and got["b"] == round(1 / 3, 6)


LAW = """# 某法

## 目 录

第一章 总则

## 第一编  总 则

### 第一章基本规定

**第一条** 甲
续行

**第二条** 乙

说明在前
| a | b |
| --- | --- |

### 第二章 其他
#### 第一节 细则
**第三条** 丙
### 第二编 分则
**一、** 修改

全国人民代表大会常务委员会关于
增加附件三的决定

（2017年11月4日通过）

**二、** 丁

附件一 名单
正文
"""


def _lines(spark, lines, columns="doc int, pos int, line string"):
    return spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], columns)


def law_units(spark, lines, name="", **how):
    """(type, label, path, body) of one law's units."""
    rows = sections.structural_units(_lines(spark, lines), "doc", "pos", "line", name=name, **how).orderBy("nth").collect()
    assert [r["nth"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r["type"], r["label"], r["path"], r["body"]) for r in rows]


def test_law_units(spark):
    units = law_units(spark, LAW.split("\n"), "某法")
    assert [(u[0], u[1], u[2]) for u in units] == [
        ("article", "第一条", "第一编 总则 > 第一章 基本规定"),
        ("article", "第二条", "第一编 总则 > 第一章 基本规定"),
        ("table", "第一章 基本规定", "第一编 总则 > 第一章 基本规定"),
        ("article", "第三条", "第一编 总则 > 第二章 其他 > 第一节 细则"),
        ("amendment_item", "一、", "第二编 分则"),
        ("amendment_item", "二、", "全国人民代表大会常务委员会关于增加附件三的决定（2017年11月4日通过）"),
    ]
    assert units[0][3] == "**第一条** 甲\n续行"


def test_law_preamble_annex_and_tables(spark):
    rows = "前面的话\n## 附件一 名单\n列\n## 附表一 税额\n| a |\n**第一条** x\n附件二 又一\ny".split("\n")
    units = law_units(spark, rows)
    assert units[0] == ("preamble", "", "", "前面的话")
    assert [(u[0], u[2]) for u in units[1:]] == [("section_text", "附件一 名单"), ("table", "附表一 税额"), ("article", "附表一 税额")]
    df = sections.structural_units(spark.createDataFrame([(1, k, x) for k, x in enumerate(rows)], "doc int, pos int, line string"), "doc", "pos", "line")
    assert [r["path"] for r in sections.kept_units(df).orderBy("nth").collect()] == ["", "附表一 税额", "附表一 税额"]


def test_long_lead_of_a_table(spark):
    units = law_units(spark, ["## 第一章 x", "长" * 50, "表一：", "| a |"], budget=20)
    assert [(u[0], u[3]) for u in units] == [("section_text", "长" * 50), ("table", "表一：\n\n| a |")]


def test_partial_lead_of_a_table(spark):
    """Not all of the lead fits: its last lines up to the lead's own limit; of one long line the last sentences; else none."""
    lines = ["## 第一章 x", "长" * 40, *("行" * 9 for _ in range(4)), "| a |"]
    assert [u[3] for u in law_units(spark, lines, budget=60, most_lead=25)] == ["\n".join(lines[1:4]), "\n".join(lines[4:6]) + "\n\n| a |"]
    long = ["## 第一章 x", "长" * 40 + "。" + "短" * 5 + "。见下表：", "| a |"]
    assert [u[3] for u in law_units(spark, long, budget=30)] == ["长" * 40 + "。", "短短短短短。见下表：\n\n| a |"]
    assert [u[3] for u in law_units(spark, ["## 第一章 x", "长" * 40, "| a |"], budget=30)] == ["长" * 40, "| a |"]


def test_lines_of_no_law(spark):
    """Null keys are a document, null lines are blank, an empty table gives no unit; other columns don't matter."""
    rows = [(None, 1, "**第一条** a"), (None, 2, None), (None, 3, "b"), (2, 1, None)]
    df = spark.createDataFrame(rows, "doc int, pos int, line string").selectExpr("*", "1 as block", "2 as kind", "3 as path")
    assert [(r["doc"], r["body"]) for r in sections.structural_units(df, "doc", "pos", "line").collect()] == [(None, "**第一条** a\nb")]
    for f in (sections.structural_units(df.limit(0), "doc", "pos", "line"), sections.parsed_blocks(df.limit(0), "doc", "pos", "line", ("x",), ()), sections.template_rows(df.limit(0).withColumn("title", F.lit("")), "doc", "pos", "line", "title")):
        assert f.count() == 0


def test_theme_sections_of_long_texts(spark):
    body = "\n".join(["第一章 甲", *("行" * 700 + str(k) for k in range(12)), "第二章 乙", "短", "第三章 丙", "长" * 9000])
    rows = sections.theme_sections(spark.createDataFrame([(1, body), (2, None), (3, "无标题" * 100)], "doc int, body string"), "doc", "body").collect()
    by = {}
    for r in rows:
        by.setdefault((r["doc"], r["path"]), []).append(r["text"])
    assert set(by) == {(1, "第一章 甲"), (1, "第三章 丙"), (3, "")}
    assert all(200 <= len(t) <= 3500 for ts in by.values() for t in ts)
    assert "".join(by[1, "第一章 甲"]).replace("\n", "") == "".join(body.split("\n")[:13])
    assert sum(t.count("长") for t in by[1, "第三章 丙"]) == 9000


def contract_blocks(spark, lines, fields, tail):
    return [(r["type"], r["text"]) for r in sections.parsed_blocks(_lines(spark, lines), "doc", "pos", "line", fields, tail).orderBy("nth").collect()]


def test_contract_blocks(spark):
    lines = ["封面", "---", "# 买卖合同", "<h2>第一章</h2>", "| 项目 | 值 |", "|---|---|", "| 质量标准 | 符合国家标准并经双方确认为准 | x |", "附注", "第一条 甲；第二条 乙", "签 字盖章"]
    assert contract_blocks(spark, lines, ("质量标准",), ("签字",)) == [("heading", "第一章"), ("paragraph", "| 项目 | 值 |"), ("heading", "质量标准：符合国家标准并经双方确认为准"), ("paragraph", "第一条 甲"), ("paragraph", "第二条 乙")]


def test_contract_blocks_of_scanned_pages(spark):
    """Blanks in a field's name, full-width bars, bold article numbers, HTML headings, and what a field's row mutes."""
    lines = ["| 质 量标准 | 符合国家标准并经双方确认为准 |", "被略去", "甲方义务：付款｜乙方义务：交货", "**第一条** 标的", "<h3>附则</h3>", "买方 ｜ 卖方", "|质量标准：按样品封存的办法执行|其他|", "# 合同尾页", "2. 价款"]
    assert contract_blocks(spark, lines, ("质量标准",), ()) == [("heading", "质 量标准：符合国家标准并经双方确认为准"), ("paragraph", "第一条 标的"), ("heading", "附则"), ("paragraph", "买方"), ("paragraph", "卖方"), ("heading", "质量标准：按样品封存的办法执行"), ("paragraph", "2. 价款")]


def test_interpretations_of_odd_documents(spark):
    docs = spark.createDataFrame([(1, "t", None), (2, "t", "没有条文"), (3, "关于修改甲的决定", "第一条 x"), (4, "t", "第一条\n第二条 本解释自公布之日起施行")], "doc int, title string, body string")
    got = sorted((r["doc"], r["kind"], r["retrieval_weight"]) for r in sections.interpretation_chunks(docs, "doc", "title", "body").collect())
    assert got == [(1, "whole", 0.9), (2, "whole", 0.9), (3, "whole", 0.5), (4, "whole", 0.9)]


def test_submission_order(spark):
    schema = "t array<struct<kind:string,name:string,artifact:string,calls:array<struct<name:string,args:string>>>>"
    call = [("submit", '{"v": 1}')]
    rows = [
        ([("tool", "submit", '{"v": 3}', None), ("tool", "submit", "broken", None), ("model", None, None, call)],),
        ([("model", None, None, call), ("model", None, None, [("submit", '{"v": 2}'), ("other", "{}")])],),
        ([("tool", "other", '{"v": 9}', None)],),
        ([],),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("n", F.monotonically_increasing_id())
    got = [r["x"] for r in df.select(messages.submission(F.col("t"), "submit", "v int").alias("x"), "n").orderBy("n").collect()]
    assert [None if g is None else g["v"] for g in got] == [3, 2, None, None]


def test_contents(spark):
    df = spark.createDataFrame([([("text", "a", None), ("thinking", None, "b"), (None, "c", None), ("reasoning", "d", "e"), ("image", None, None)],), (None,)], "b array<struct<type:string,text:string,thinking:string>>")
    got = [(r[0], r[1]) for r in df.select(messages.content_text(F.col("b")), messages.content_thoughts(F.col("b"))).collect()]
    assert got[0] == ("ac", "bd")


def test_cache_key_is_stable_json(spark):
    import hashlib
    import json

    payload = {"a": 1, "b": "x\"y"}
    want = hashlib.sha256(json.dumps({"task": "t", "prompt_hash": "p", "input": payload, "model": "m"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    got = one(spark, artifacts.cache_key(F.lit("t"), F.lit("p"), F.lit(json.dumps(payload, sort_keys=True, separators=(",", ":"))), F.lit("m")), x=1)
    assert got == want


def test_replacement_by_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    artifacts.write_replaced(rows, path, "k")
    artifacts.write_replaced(spark.createDataFrame([("a", 9)], "k string, v int"), path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]


def test_plan_is_not_applied_unasked(spark):
    files = spark.createDataFrame([("t", "a", True, 1), ("t", "b", False, 9), ("", "c", False, 1), ("", "d", False, 1)], "title string, name string, is_full boolean, size int")
    plan = artifacts.deletion_plan(files, "title", "name", F.col("is_full"), F.col("size"))
    assert [(r["delete"], r["keep"]) for r in plan.collect()] == [("b", "a")]
    assert artifacts.planned(files, plan, "name").count() == 4 and artifacts.planned(files, plan, "name", apply=True).count() == 3


def test_packing_by_tokens():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    size = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert size("") == 0 and size("hello world") == 2
    packed = packing.pack_units([("", "hello world")] * 10, 10, size)
    assert all(size(text) <= 11 for _, text, _, _ in packed) and sum(n for _, _, n, _ in packed) == 10


def test_split_documents_lose_nothing(spark):
    """Over the whole table: pieces fit, and together have every character but white space."""
    rows = catalog.QUERIES["split_oversize"](spark, SF).orderBy("doc_id", "chunk").collect()
    whole = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    made = {}
    for r in rows:
        assert len(r["text"]) <= 1500
        made[r["doc_id"]] = made.get(r["doc_id"], "") + r["text"]
    bare = lambda t: "".join((t or "").split())
    assert {i: bare(t) for i, t in made.items()} == {i: bare(t) for i, t in whole.items() if bare(t)}


class EveryContainer(HTMLParser):
    """The text of each container by itself."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.texts, self.skip, self.all = [], [], 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in html.SKIPPED
        if tag in html.BREAKS and tag not in html.SKIPPED:
            self.handle_data("\n")
        if tag in html.CONTAINERS:
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in html.SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag in html.CONTAINERS and tag in [t for t, _ in self.open]:
            while True:
                name, parts = self.open.pop()
                if name != "body":
                    self.texts.append(html.tidy("".join(parts)))
                if name == tag:
                    return

    def handle_data(self, data):
        if not self.skip:
            self.all.append(data)
            for _, parts in self.open:
                parts.append(data)


def test_main_text_by_brute_force(spark):
    """Over the whole table, the longest text of any container; so it is for pages with tags that don't fit."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["main_text"] for r in catalog.QUERIES["html_main_text"](spark, SF).collect()}
    assert set(got) == set(pages)
    for key, page in pages.items():
        best = max(EveryContainer(page).texts, key=len, default="")
        assert got[key] == (best if len(best) >= 200 else html.tidy("".join(EveryContainer(page).all)))
    for page in ("<div>a<div>bb</div>", "<body><div>a</div></p><article>bcd</div></body>", "<div><article>abc</div>de", "x", "", "<section>" * 2000 + "deep" + "</section>" * 2000):
        best = max(EveryContainer(page).texts, key=len, default="")
        assert len(html.main_text(page, 1)) >= len(best)


def test_byte_order_mark(spark, tmp_path):
    from corpusloom.sources import sinks

    sinks.write_csv(spark.createDataFrame([(1, None, ["a"])], "n int, s string, l array<string>").coalesce(1), str(tmp_path / "c"))
    (file,) = (tmp_path / "c").glob("*.csv")
    assert file.read_bytes().startswith(b"\xef\xbb\xbfn,s,l")
    assert [tuple(r) for r in sinks.read_csv(spark, str(tmp_path / "c")).collect()] == [("1", "", '["a"]')]


def test_docx_rows(spark):
    import io
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>一</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    df = spark.createDataFrame([("f", out.getvalue())], "path string, content binary")
    assert [(r["kind"], r["text"]) for r in html.docx_rows(df).orderBy("pos").collect()] == [("paragraph", "一"), ("table", "| a |  |")]


def test_cosine_measures_once(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [-3.0, 4.0])], "vec_id int, embedding array<double>")
    got = {r["vec_id"]: r["score"] for r in retrieval.scored(spark.createDataFrame([(9, [3.0, 4.0])], "query_id int, query array<double>"), v).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.28}


def test_stratified_bounds(spark):
    from corpusloom.operators import windows

    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 980, "a").otherwise("b").alias("label"))
    got = windows.stratified(rows, "label", ["a", "b", "c"], 10, "id", "s")
    counts = {r["label"]: r["count"] for r in got.groupBy("label").count().collect()}
    assert counts == {"a": 4, "b": 3}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_names_within(spark):
    random.seed(3)
    word = lambda: "".join(random.choice("ab") for _ in range(random.randint(0, 5)))
    left, right = {word() for _ in range(20)}, {word() for _ in range(20)}
    frame = lambda names, c: spark.createDataFrame([(n,) for n in names], f"{c} string")
    got = {tuple(r) for r in joins.names_within(frame(left, "name"), frame(right, "other")).collect()}
    assert got == {(a, b) for a in left for b in right if a and b and (a in b or b in a)}


def test_let_and_shares(spark):
    assert one(spark, rules.table_share(F.col("t")), t="| a |\nb\n|\n\n") == pytest.approx(2 / 3)
    assert one(spark, rules.placeholder_share(F.col("t")), t="____ab") == 1.0
    assert one(spark, rules.placeholder_share(F.col("t")), t="") == 1.0
    assert one(spark, text.compact(F.col("t")), t="a　b  c\n") == "abc"
    assert math.isclose(one(spark, rules.placeholder_share(F.col("t")), t="年 月 日abc"), 0.5)


def template_clauses(spark, lines, title=None):
    rows = sections.template_rows(_lines(spark, lines).withColumn("title", F.lit(title)), "doc", "pos", "line", "title").orderBy("nth").collect()
    return [(r["number"], r["title"], r["section_path"], r["text"]) for r in rows]


def test_template_clauses(spark):
    lines = ["使用说明", "本示范文本供当事人参考使用，双方可以作出调整。", "根据《某法》订立本合同，当事人应当遵守下列约定：", "通用条款", "第一条 标的", "1.1 小项", "1. 价款", "短", "第二章 杂项", "2.1 通知：书面", "x", "第三条 a"]
    assert template_clauses(spark, lines) == [
        ("", "", "使用说明", lines[1]),
        ("", "", "合同正文", lines[2]),
        ("第一条", "标的", "合同正文 / 通用条款", "第一条 标的\n1.1 小项\n1. 价款\n短"),
        ("2.1", "通知：书面", "合同正文 / 通用条款 / 第二章 杂项", "2.1 通知：书面\nx"),
    ]
    assert template_clauses(spark, ["没有条号"], "某文本") == [("", "某文本", "未编号文本", "没有条号")]
    assert template_clauses(spark, []) == []


def test_tables_are_made_once(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from corpusloom.operators import store

    old = StructType([StructField("id", LongType())])
    spark.sql("DROP TABLE IF EXISTS made_once")
    for schema in (old, old, StructType([*old.fields, StructField("name", StringType())]), old):
        store.ensure_table(spark, "made_once", schema)
    assert spark.table("made_once").columns == ["id", "name"] and spark.table("made_once").count() == 0
    spark.sql("DROP TABLE made_once")
