"""Structure of documents: lines, sections, articles, clauses, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions.text import sentences
from corpusloom.operators import markdown, packing, segments
from corpusloom.operators import sections as laws
from corpusloom.plans.registry import query
from corpusloom.sources.readers import table

_LINES = r"""with raw as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
l as (select doc_id, pos, regexp_replace(regexp_replace(line, '[\s\x0B]+', ' ', 'g'), '^ | $', '', 'g') as line from raw), lines as (select * from l where line <> '')
"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(_LINES + "select doc_id, pos, line from lines")
def line_explode(spark, sf_dir):
    """Non-empty lines of documents (G1)."""
    return segments.line_rows(_docs(spark, sf_dir), "doc_id", "text")


@query(_LINES + """, s as (select *, sum(case when regexp_matches(line, '^The') then 1 else 0 end) over (partition by doc_id order by pos) as segment from lines)
select doc_id, segment, arg_min(line, pos) as title, string_agg(line, chr(10) order by pos) as body, count(*) as n_lines from s group by doc_id, segment""")
def sections(spark, sf_dir):
    """Sections that begin at marker lines."""
    return segments.sections(_docs(spark, sf_dir), "doc_id", "text", "^The")


_STATUTE = "'第一编 总则' || chr(10) || '第一章 ' || o_orderstatus || chr(10) || 'lead' || chr(10) || '第一条 ' || o_orderpriority || chr(10) || '续' || chr(10) || '第二节 x' || chr(10) || '第二条 y'"


@query("""select o_orderkey, 1 as segment, '第一条' as article_no, '第一条 ' || o_orderpriority || ' 续' as body, '第一编 总则' as part, '第一章 ' || o_orderstatus as chapter, null as section from orders
union all select o_orderkey, 2, '第二条', '第二条 y', '第一编 总则', '第一章 ' || o_orderstatus, '第二节 x' from orders""")
def articles(spark, sf_dir):
    """Articles with their part, chapter and section (G1, O2)."""
    o = table(spark, sf_dir, "orders")
    law = F.concat(F.lit("第一编 总则\n第一章 "), F.col("o_orderstatus"), F.lit("\nlead\n第一条 "), F.col("o_orderpriority"), F.lit("\n续\n第二节 x\n第二条 y"))
    return segments.articles(o.select("o_orderkey", law.alias("text")), "o_orderkey", "text")


@query("""select o_orderkey, 0 as segment, 'pre' as title, 'pre' as body from orders union all select o_orderkey, 1, '一、a', '一、a' from orders union all select o_orderkey, 2, '第一条 ' || o_orderstatus, '第一条 ' || o_orderstatus || chr(10) || '1. inside' from orders""")
def clauses(spark, sf_dir):
    """Clauses; outline items stay inside articles."""
    o = table(spark, sf_dir, "orders")
    contract = F.concat(F.lit("pre\n一、a\n第一条 "), F.col("o_orderstatus"), F.lit("\n1. inside"))
    return segments.clauses(o.select("o_orderkey", contract.alias("text")), "o_orderkey", "text")


@query("""select o_orderkey, o_orderstatus as facts, o_orderpriority as holding from orders""")
def markdown_fields(spark, sf_dir):
    """Markdown sections as fields."""
    o = table(spark, sf_dir, "orders")
    case = F.concat(F.lit("# t\n## facts\n"), F.col("o_orderstatus"), F.lit("\n## holding\n"), F.col("o_orderpriority"))
    return segments.markdown_fields(o.select("o_orderkey", case.alias("text")), "o_orderkey", "text").select("o_orderkey", F.col("fields")["facts"].alias("facts"), F.col("fields")["holding"].alias("holding"))


@query("""with d as (select o_custkey, o_orderpriority, min(o_orderkey) as pos from orders group by all)
select o_custkey, string_agg(o_orderpriority, ',' order by pos) as outline from d group by o_custkey""")
def outlines(spark, sf_dir):
    """Distinct labels of a document in order."""
    return segments.outline(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.col("o_orderpriority")).select("o_custkey", F.array_join("outline", ",").alias("outline"))


_LINE_ROWS = r"""l as (select doc_id, row_number() over (partition by doc_id order by pos) as rn, line from (
  select doc_id, unnest(range(len(x))) as pos, regexp_replace(regexp_replace(unnest(x), '[\s\x0B]+', ' ', 'g'), '^ | $', '', 'g') as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)) where line <> '')"""


@query("with recursive " + _LINE_ROWS + """, w(doc_id, rn, chunk, used, line) as (
  select doc_id, rn, 0::bigint, length(line), line from l where rn = 1
  union all select l.doc_id, l.rn, case when w.used + 1 + length(l.line) <= 400 then w.chunk else w.chunk + 1 end, case when w.used + 1 + length(l.line) <= 400 then w.used + 1 + length(l.line) else length(l.line) end, l.line from w join l on l.doc_id = w.doc_id and l.rn = w.rn + 1)
select doc_id, chunk, '' as path, string_agg(line, chr(10) order by rn) as text, count(*) as units, max(length(line)) > 400 as overflow from w group by doc_id, chunk""")
def pack_greedy(spark, sf_dir):
    """Lines of documents packed to a budget."""
    lines = segments.line_rows(_docs(spark, sf_dir), "doc_id", "text").withColumn("path", F.lit(""))
    return packing.packed(lines, "doc_id", "pos", "path", "line", 400)


@query(r"""with recursive s as (select doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '[.] ?', '。', 'g'), '[^。！？；]*[。！？；]|[^。！？；]+$') as s from documents),
p as (select doc_id, s, len(s) as n, list_prepend(0, list_transform(range(1, len(s) + 1), lambda k: list_sum(list_transform(s[1:k], lambda x: length(x))))) as p from s where len(s) > 0),
c(doc_id, chunk, a, e) as (
  select doc_id, 0::bigint, 0::bigint, greatest(1, len(list_filter(p, lambda x: x > 0 and x <= 300))) from p
  union all select d.doc_id, d.chunk + 1, d.a, d.a + greatest(1, len(list_filter(d.p, lambda x: x > d.p[d.a + 1] and x <= d.p[d.a + 1] + 300))) from (
    select c.doc_id, c.chunk, p.p, greatest(c.a + 1, c.e - len(list_filter(p.p, lambda x: x < p.p[c.e + 1] and x >= p.p[c.e + 1] - 60))) as a from c join p on p.doc_id = c.doc_id where c.e < p.n) d)
select c.doc_id, c.chunk, '' as label, array_to_string(s[a + 1:e], '') as text from c join p on p.doc_id = c.doc_id""")
def pack_overlap(spark, sf_dir):
    """Sentences packed with overlap."""
    said = _docs(spark, sf_dir).select("doc_id", F.posexplode(sentences(F.regexp_replace("text", "[.] ?", "。"))).alias("pos", "line")).withColumn("label", F.lit(""))
    return packing.overlapping(said, "doc_id", "pos", "label", "line", 300, 60)


@query()
def split_oversize(spark, sf_dir):
    """Oversize documents in pieces."""
    return packing.split_documents(_docs(spark, sf_dir), "doc_id", "text", 1500)


@query()
def split_by_tokens(spark, sf_dir):
    """Oversize documents in pieces of at most 512 tokens of a public byte-level tokenizer."""
    size = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.split_documents(_docs(spark, sf_dir), "doc_id", "text", 512, size)


@query("""with i as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as item, l_quantity as score, l_returnflag as f, l_linestatus as s from lineitem),
r as (select *, row_number() over (partition by l_orderkey order by score desc, item) as rank from i), one as (select * from r where rank = 1),
two as (select r.l_orderkey, arg_min(r.item, (r.f in (one.f, one.s) and r.s in (one.f, one.s), r.rank)) as item from r join one on one.l_orderkey = r.l_orderkey where r.rank > 1 group by r.l_orderkey)
select l_orderkey, item, 1::bigint as nth from one union all select l_orderkey, item, 2 from two""")
def diverse_select(spark, sf_dir):
    """Greedy diverse choice of lines in each order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).cast("long").alias("item"), F.col("l_quantity").cast("double").alias("score"), F.array("l_returnflag", "l_linestatus").alias("dims"))  # noqa: E741
    return packing.diverse(l, "l_orderkey", "item", "score", "dims", 2)


# line items as numbered lines of a document for each order
_NUMBERED = """with i as (select l_orderkey, l_quantity::int as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from lineitem)"""


def _numbered(spark, sf_dir, *lines, end=None):
    """(l_orderkey, pos, line): for each line item, numbered n in its order, the given lines that aren't null; ``end`` once after all."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("q"), F.row_number().over(w).alias("n"), F.lead(F.lit(1)).over(w).isNull().alias("last"))
    made = [F.struct((F.col("n") * 100 + k).alias("pos"), line.alias("line")) for k, line in enumerate(lines)]
    if end is not None:
        made.append(F.struct(F.lit(1_000_000).alias("pos"), F.when(F.col("last"), end).alias("line")))
    return items.select("l_orderkey", F.inline(F.array(*made))).filter("line is not null")


@query(_NUMBERED + """, u as (select l_orderkey, n, 1 as k, 'article' as type, '第' || n || '条' as label, '第' || (n - (n - 1) % 4) || '章 货物' as path, '**第' || n || '条** 数量' || q || chr(10) || '续' as body from i
  union all select l_orderkey, n, 2, 'table', '第' || (n - (n - 1) % 4) || '章 货物', '第' || (n - (n - 1) % 4) || '章 货物', '| ' || q || ' | x |' from i where n % 3 = 0)
select l_orderkey, row_number() over (partition by l_orderkey order by n, k) as nth, type, label, path, body from u""")
def structural_units(spark, sf_dir):
    """Articles and tables of laws with their chapters, whatever the headings' Markdown levels."""
    n = F.col("n")
    head = F.when(n % 4 == 1, F.concat(F.when(n % 8 == 1, "## 第").otherwise("#### 第"), n, F.lit("章货物")))
    lines = _numbered(spark, sf_dir, F.when(n == 1, "# 某法"), F.when(n == 1, "## 目 录"), F.when(n == 1, "第九章 目录里"), head, F.concat(F.lit("**第"), n, F.lit("条** 数量"), "q"), F.lit("续"), F.when(n % 3 == 0, F.concat(F.lit("| "), "q", F.lit(" | x |"))))
    return laws.structural_units(lines, "l_orderkey", "pos", "line")


@query(_NUMBERED + """, s as (select l_orderkey, (n - 1) // 3 as g, min(n) as first, count(*) as lines, sum(length(repeat('字', 100 + q)) + 1) as size from i group by l_orderkey, (n - 1) // 3)
select l_orderkey, g + 1 as section, 1 as part, '第' || first || '章 部分' as path, 5 + length(first::varchar) + size as size from s where 5 + length(first::varchar) + size >= 200""")
def theme_sections(spark, sf_dir):
    """Theme sections of guides by heading rank, without short ones."""
    n = F.col("n")
    lines = _numbered(spark, sf_dir, F.when(n % 3 == 1, F.concat(F.lit("第"), n, F.lit("章 部分"))), F.repeat(F.lit("字"), 100 + F.col("q")))
    docs = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l")).select("l_orderkey", F.array_join("l.line", "\n").alias("body"))
    return laws.theme_sections(docs, "l_orderkey", "body").select("l_orderkey", "section", "part", "path", F.length("text").alias("size"))


@query(_NUMBERED + """, b as (select l_orderkey, n, 1 as k, 'heading' as type, '质量标准：' || repeat('优', 12) || q as text from i where n % 3 = 0
  union all select l_orderkey, n, 1, 'paragraph', '第' || n || '条 数量' || q from i where n % 3 = 1 union all select l_orderkey, n, 2, 'paragraph', '第' || n || '条 价款' from i where n % 3 = 1
  union all select l_orderkey, n, 1, 'paragraph', '杂项' || n from i where n % 3 = 2)
select l_orderkey, row_number() over (partition by l_orderkey order by n, k) as nth, type, text from b""")
def contract_blocks(spark, sf_dir):
    """Blocks of contracts in Markdown: fields of tables, found by names with blanks and written without, clauses, what is left out."""
    n = F.col("n")
    start = [F.when(n == 1, x) for x in ("封面", "---", "# 某合同", "<!-- note -->")]
    clause = F.when(n % 3 == 1, F.concat(F.lit("**第"), n, F.lit("条** 数量"), "q", F.lit("；第"), n, F.lit("条 价款；")))
    lines = _numbered(spark, sf_dir, *start, clause, F.when(n % 3 == 2, F.concat(F.lit("杂项"), n)), F.when(n % 3 == 0, F.concat(F.lit("| 质 量标准 | "), F.repeat(F.lit("优"), 12), "q", F.lit(" |"))), F.when(n % 3 == 0, "附注在表后"), F.when(n % 3 == 2, "甲方盖 章"))
    blocks = laws.parsed_blocks(lines, "l_orderkey", "pos", "line", ("质量标准",), ("盖章",))
    return blocks.withColumn("text", F.replace("text", F.lit("质 量"), F.lit("质量")))


@query(_NUMBERED + """, g as (select l_orderkey, n, (greatest(n, 2) - 2) // 3 as chunk from i), h as (select l_orderkey, count(*) as total from i group by l_orderkey)
select g.l_orderkey, chunk, '| 0001 |' || coalesce(string_agg(chr(10) || '| ' || lpad(n::varchar, 4, '0') || ' |', '' order by n) filter (n > 1), '') as text from g group by g.l_orderkey, chunk""")
def split_tables(spark, sf_dir):
    """Tables in pieces within a budget, each with the header."""
    lines = _numbered(spark, sf_dir, F.concat(F.lit("| "), F.lpad(F.col("n").cast("string"), 4, "0"), F.lit(" |")))
    return packing.split_tables(lines, "l_orderkey", "pos", "line", 1, 40)


@query(_NUMBERED + """, c as (select l_orderkey, n, '第' || n || '条' as number, '标的' || q as title, '第' || (n - (n - 1) % 3) || '部分 货物' as p, n - (n - 1) % 3 as first, '第' || n || '条 标的' || q || chr(10) || '1.1 小项' || chr(10) || '续' as text from i)
select l_orderkey, row_number() over (partition by l_orderkey order by n) as nth, number, title,
  array_to_string(list_transform(list_filter(range(1, 40, 3), lambda k: k <= first and k > first - 12), lambda k: '第' || k || '部分 货物'), ' / ') as section_path, text from c""")
def template_clauses(spark, sf_dir):
    """Clauses of contract templates below the last four part headings, with numbers inside them."""
    n = F.col("n")
    lines = _numbered(spark, sf_dir, F.when(n % 3 == 1, F.concat(F.lit("第"), n, F.lit("部分 货物"))), F.concat(F.lit("第"), n, F.lit("条  标的"), "q"), F.lit("1.1 小项"), F.lit("续")).withColumn("title", F.lit("某合同"))
    return laws.template_rows(lines, "l_orderkey", "pos", "line", "title")


@query(_NUMBERED + """, b as (select l_orderkey, 0 as n, 1 as k, '某合同' as x from i where n = 1 union all select l_orderkey, 0, 2, '## 目录' from i where n = 1
  union all select l_orderkey, 0, 3, '- 第1章 总则' || chr(10) || '- 第2章 分则' || chr(10) || '- 附件一' from i where n = 1
  union all select l_orderkey, n, 1, '## 第' || n || '章　' || case n when 1 then '总则' else '分则' end from i where n <= 2 union all select l_orderkey, n, 2, '### 第' || n || '节　货物' from i where n % 2 = 0
  union all select l_orderkey, n, 3, '**第' || n || '条**　数量' || q || case when n % 3 = 0 then '____；' else '' end from i union all select l_orderkey, 1000, 1, '## 附件一' from i where n = 1)
select l_orderkey, string_agg(x, chr(10) || chr(10) order by n, k) as markdown from b group by l_orderkey""")
def text_markdown(spark, sf_dir):
    """Texts with tables of contents, torn articles, blanks and page numbers as Markdown."""
    n = F.col("n")
    start = [F.when(n == 1, x) for x in ("某合同", "目 录", "第1章 总则……1 第2章 分则……7", "附件一 ... 9")]
    chapter = F.when(n <= 2, F.concat(F.lit("第"), n, F.lit("章 "), F.when(n == 1, "总则").otherwise("分则")))
    lines = _numbered(spark, sf_dir, *start, chapter, F.when(n % 2 == 0, F.concat(F.lit("第"), n, F.lit("节　货物"))), F.concat(F.lit("第"), n, F.lit("条")), F.when(n % 5 == 0, "- 12 -"), F.concat(F.lit("数量"), "q"), F.when(n % 3 == 0, "____；"), end="附件一")
    return markdown.documents(lines, "l_orderkey", "pos", "line")
