"""Legal texts. Titles and bodies in the language of the functions are made of the rows of the tables, of every kind that a function tells apart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import legal
from corpusloom.operators import sections
from corpusloom.plans.registry import query
from corpusloom.sources.readers import table


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def _one_of(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("""select o_orderkey, year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' || chr(10) || '正文' || chr(10) || '第' || o_orderkey || '条，法释〔' || o_custkey || '〕' || (o_orderkey % 90 + 10) || '号' as text from orders""")
def rejoined_numbers(spark, sf_dir):
    """Dates, articles and document numbers that line breaks had torn."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey") % 90 + 10
    torn = F.concat(F.year("o_orderdate"), F.lit("\n年\n"), F.month("o_orderdate"), F.lit(" \n\n月\n "), F.day("o_orderdate"), F.lit("\n日\n正文\n第\n"), F.col("o_orderkey"), F.lit("\n条，法释〔\n"), F.col("o_custkey"), F.lit("\n〕\n"), F.floor(n / 10), F.lit("\n"), n % 10, F.lit("\n号"))
    return o.select("o_orderkey", legal.rejoin_numbers(torn).alias("text"))


_ANNOUNCED, _NUMBERED, _TITLES = ("高等法院、检察院公告", "高等法院公告"), r"法释〔\d{4}〕\d+号", ("高等法院关于", "检察院关于")


@query("""with m as (select p_partkey, p_brand, p_type, p_size, case p_size % 6 when 0 then '高等法院公告' || p_type when 1 then '高等法院关于' || p_brand || '检察院关于此 法释〔2020〕' || p_size || '号 ' || p_type when 2 then '法释〔2019〕1号 ' || p_type
  when 3 then '高等法院关于' || p_type when 4 then '高等法院公告' || p_brand || '高等法院、检察院公告' || p_type else p_type end as legal,
  case p_size % 6 when 2 then 1600 else 0 end as back, repeat(replace(p_name, ' ', '') || '。', 3 + p_size * 4) as front from part)
select p_partkey, case p_size % 6 when 5 then '' when 4 then front || '高等法院公告' || p_brand when 2 then left(front, greatest(0, length(front) - 1600)) else front end as explanation,
  case p_size % 6 when 5 then front || legal when 4 then '高等法院、检察院公告' || p_type when 2 then substr(front, greatest(0, length(front) - 1600) + 1) || legal else legal end as legal_text from m""")
def boundary_split(spark, sf_dir):
    """Explanations and the legal texts after them, by announcement, document number or title."""
    kind = F.col("p_size") % 6
    body = (
        F.when(kind == 0, F.concat(F.lit("高等法院公告"), "p_type"))
        .when(kind == 1, F.concat(F.lit("高等法院关于"), "p_brand", F.lit("检察院关于此 法释〔2020〕"), F.col("p_size"), F.lit("号 "), "p_type"))
        .when(kind == 2, F.concat(F.lit("法释〔2019〕1号 "), "p_type"))
        .when(kind == 3, F.concat(F.lit("高等法院关于"), "p_type"))
        .when(kind == 4, F.concat(F.lit("高等法院公告"), "p_brand", F.lit("高等法院、检察院公告"), "p_type"))
        .otherwise(F.col("p_type"))
    )
    front = F.repeat(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("。")), 3 + F.col("p_size") * 4)
    parts = legal.split_legal_text(F.concat(front, body), _ANNOUNCED, _NUMBERED, _TITLES, "(高等法院|检察院)关于")
    return _part(spark, sf_dir).select("p_partkey", parts.alias("p")).select("p_partkey", "p.*")


@query("""select p_partkey, concat_ws(',', case when p_size % 2 = 0 then '合同法' end, case when p_size % 3 = 0 then '物权法' end, case when p_size % 5 = 0 then '继承法' end) as laws from part""")
def legacy_law_refs(spark, sf_dir):
    """Superseded laws that a text names."""
    size = F.col("p_size")
    text = F.concat("p_name", F.when(size % 5 == 0, "《继承法》").otherwise(""), F.when(size % 3 == 0, "中华人民共和国物权法").otherwise(""), F.when(size % 2 == 0, "依合同法处理").otherwise(""))
    return _part(spark, sf_dir).select("p_partkey", F.array_join(legal.legacy_laws(text), ",").alias("laws"))


_PLAINTIFFS, _DEFENDANTS = ("荣某", "北京某有限公司", "甲银行"), ("某汽车销售公司", "广州沃某模具有限公司、张某某等", "张某某等", "李某、王某某", "上海港务集团与王小某甲")
_CAUSES = ("买卖合同纠纷", "侵害计算机软件著作权纠纷", "损害公司利益责任纠纷", "民间借贷纠纷", "金融借款合同纠纷")
_FORMS = ("指导性案例{}号：", "参考案例 入库编号{}：", "")


@query(f"""select p_partkey, {_sql_list(_CAUSES)}[p_partkey % 5 + 1] as cause, case when p_size % 4 = 0 then '' else {_sql_list(("民事", "商事", "执行"))}[p_size % 3 + 1] end as kind,
  {_sql_list(_CAUSES)}[p_partkey % 5 + 1] || '·' || p_brand as keywords, case when p_size % 2 = 0 then p_type || '是否成立？' else '' end as focus from part""")
def cases_taken_apart(spark, sf_dir):
    """Causes of action without parties, case types, keywords and the point in dispute."""
    key, size = F.col("p_partkey"), F.col("p_size")
    number = F.replace(_one_of(_FORMS, size), F.lit("{}"), key.cast("string"))
    cause = _one_of(_CAUSES, key)
    title = F.concat(number, _one_of(_PLAINTIFFS, size), F.lit("诉"), _one_of(_DEFENDANTS, F.floor(key / 5)), cause, F.lit("案"))
    kind = F.when(size % 4 == 0, "其他类").otherwise(_one_of(("民事", "商事", "执行"), size))
    known = F.when(size % 4 == 0, F.concat_ws("/", cause, "p_brand")).otherwise(F.concat_ws("/", kind, cause, "p_brand"))
    reasoning = F.concat(F.lit("本院认为，"), F.when(size % 2 == 0, F.concat(F.lit("本案的争议焦点为："), "p_type", F.lit("是否成立？\n其余"))).otherwise("焦点明确。"))
    return _part(spark, sf_dir).select("p_partkey", legal.cause_of_action(title, _CAUSES).alias("cause"), legal.case_type(F.concat_ws("/", kind, cause)).alias("kind"), legal.keywords_line(known).alias("keywords"), legal.dispute_focus(reasoning).alias("focus"))


_FUNCTIONS = {"payment": ("STEEL", "payment"), "quality": ("BRASS", "quality"), "delivery": ("COPPER",), "small": ("SMALL",)}
_RISKS = {"large": ("LARGE",), "plated": ("PLATED",)}


def _case(label, words, column):
    return f"case when {' or '.join(f'contains({column}, {chr(39)}{w}{chr(39)})' for w in words)} then '{label}' end"


@query(f"""with h as (select p_partkey, p_size, list_filter([{', '.join(_case(k, w, 'p_type') for k, w in _FUNCTIONS.items())}], lambda x: x is not null)[1:2] as f, concat_ws(',', {', '.join(_case(k, w, 'p_type') for k, w in _RISKS.items())}) as risks from part)
select p_partkey, array_to_string(case when p_size % 3 = 0 and not list_contains(f, 'quality') then list_append(f, 'quality') when p_size % 3 = 1 and not list_contains(f, 'delivery') then list_append(f, 'delivery') else f end, ',') as functions, risks from h""")
def semantic_fingerprints(spark, sf_dir):
    """Labels of several taxonomies, of which known clause types extend one."""
    kinds = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("quality of goods"), F.lit(""))).when(F.col("p_size") % 3 == 1, F.array(F.lit("OPP"))).otherwise(F.array().cast("array<string>"))
    marks = legal.fingerprint(F.col("p_type"), {"functions": (_FUNCTIONS, 2), "risks": (_RISKS, 6)}, kinds, "functions")
    return _part(spark, sf_dir).select("p_partkey", marks.alias("m")).select("p_partkey", F.array_join("m.functions", ",").alias("functions"), F.array_join("m.risks", ",").alias("risks"))


@query("""with d as (select doc_id, text, n_chars, case doc_id % 7 when 0 then '培训通知' when 1 then '合同起草指引' when 2 then '尽职调查办法' when 3 then '股票业务' when 4 then '诉讼业务之股票' when 5 then '劳动' else '其他' end as title, case when doc_id % 11 = 0 then 'P1' else 'P0_CONTRACT' end as p from documents)
select doc_id, case when doc_id % 7 = 0 then 'review_drop' when length(text) < 800 or p = 'P1' or doc_id % 7 = 2 then 'review' when doc_id % 7 in (1, 3) then 'include_main' else 'review' end as decision,
  case when doc_id % 7 = 0 then 'event or notice' when length(text) < 800 then 'short text' when p = 'P1' then 'adjacent subject' when doc_id % 7 = 2 then 'broad or compliance subject' when doc_id % 7 = 4 then 'litigation' when doc_id % 7 in (1, 3) then 'contract subject'
    when doc_id % 7 = 5 then 'broad adjacent subject' else 'no direct subject' end as reason,
  case when contains(text, '|') then false else doc_id % 5 in (0, 1) or (doc_id % 5 <> 4 and contains(left(text, 800), 'the ')) end as template_stays from d""")
def second_pass(spark, sf_dir):
    """Second filters of guides and of contract templates."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    title = _one_of(("培训通知", "合同起草指引", "尽职调查办法", "股票业务", "诉讼业务之股票", "劳动", "其他"), F.col("doc_id"))
    guide = legal.playbook_second_pass(F.when(F.col("doc_id") % 11 == 0, "P1").otherwise("P0_CONTRACT"), title, title, F.col("text"), ("股票",), ("劳动",), ("尽职调查",), ("培训",), ("诉讼",))
    kind = F.col("doc_id") % 5
    template = legal.template_second_pass(F.when(kind == 0, "P0_STANDARD").otherwise("P1"), F.concat(F.when(F.contains("text", F.lit("|")), "告知书").otherwise(""), F.when(kind == 1, "运单").otherwise("文本")), F.when(kind == 4, "").otherwise(F.col("text")), ("告知书",), ("运单",), ("the ",))
    return d.select("doc_id", guide.alias("g"), template["keep"].alias("template_stays")).select("doc_id", F.col("g.priority").alias("decision"), "g.reason", "template_stays")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then o_orderpriority || '适用' when o_orderkey % 3 = 1 then '民法典' || o_orderpriority || '解释' else '未命名' end as name from orders""")
def short_names(spark, sf_dir):
    """Short names of interpretations."""
    o = table(spark, sf_dir, "orders")
    title = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("最高人民法院关于审理"), "o_orderpriority", F.lit("纠纷案件适用适用法律若干问题的"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("关于适用《中华人民共和国民法典》有关"), "o_orderpriority", F.lit("问题的解释"))).otherwise("")
    return o.select("o_orderkey", legal.short_name(title).alias("name"))


# a text of each order: a preface, and for each line a section line now and then, an article and a line that goes on; returned lines are procedural
_LINES = """select l_orderkey, n as l_linenumber, l_returnflag, q, (n % 3 = 0)::int as heads from (select l_orderkey, l_returnflag, l_quantity::int as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from lineitem)"""


@query(f"""with l as ({_LINES}), s as (select *, max(case when heads = 1 then l_linenumber end) over (partition by l_orderkey order by l_linenumber) as sec from l)
select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber) as nth, case when sec is not null then '货物' || sec end as section, '第' || l_linenumber || '条' as article_no, '数量为' || q || '。' || chr(10) || '续' as body from s where l_returnflag <> 'R'""")
def interpretation_articles(spark, sf_dir):
    """Articles of interpretations with their section, without preface and procedural ones."""
    return sections.interpretation_articles(_interpretations(spark, sf_dir), "doc_id", "body").select("doc_id", "nth", "section", "article_no", F.col("body_only").alias("body"))


def _interpretations(spark, sf_dir):
    line = F.concat(
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("三、货物"), F.col("l_linenumber"), F.lit("\n"))).otherwise(""),
        F.lit("第"), F.col("l_linenumber"), F.lit("条 "),
        F.when(F.col("l_returnflag") == "R", "本解释自公布之日起施行").otherwise(F.concat(F.lit("数量为"), F.col("l_quantity").cast("int"), F.lit("。"))),
        F.lit("\n续"),
    )
    items = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    rows = items.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("lines"))
    return rows.select("doc_id", F.concat(F.lit("前言 第九条 \n"), F.array_join("lines.line", "\n")).alias("body"))


@query(f"""with a as (select l_orderkey, count(*) filter (l_returnflag <> 'R') as n from lineitem group by l_orderkey)
select o_orderkey as doc_id, case when o_orderkey % 4 = 0 then 'whole' when n > 0 then 'article' else 'whole' end as kind, case when o_orderkey % 4 = 0 then 0.5 when n > 0 then 1.0 else 0.9 end as weight, case when o_orderkey % 4 <> 0 and n > 0 then n else 1 end as chunks
from orders join a on l_orderkey = o_orderkey""")
def interpretation_chunks(spark, sf_dir):
    """Chunks of interpretations: an article each, or the whole text of amendments and of texts without articles."""
    docs = _interpretations(spark, sf_dir).withColumn("title", F.when(F.col("doc_id") % 4 == 0, "关于修改某解释的决定").otherwise("关于某案件的解释"))
    chunks = sections.interpretation_chunks(docs, "doc_id", "title", "body")
    return chunks.groupBy("doc_id", "kind", F.col("retrieval_weight").alias("weight")).agg(F.count(F.lit(1)).alias("chunks"))


@query("""select page_id, '**1.' || case when regexp_extract(url, '([^/]+)$', 1) = '' then '' else ' ' || regexp_extract(url, '([^/]+)$', 1) end || '**' || chr(10) || chr(10) || 'see ' || page_id || ' here' || chr(10) || chr(10) || '**2.**' || chr(10) || chr(10) || 'alone' as tips, 2 as n from pages""")
def risk_tips(spark, sf_dir):
    """Risk tips of pages, numbered."""
    title = F.regexp_extract("url", "([^/]+)$", 1)
    html = F.concat(F.lit("<html><ul><li class='x samr-view-risk-item'><b class=\"title\">"), title, F.lit("</b><p class='content'>see <i>"), F.col("page_id"), F.lit("</i>\n here</p></li>\n<li class=\"samr-view-risk-item\"><p class='content'>alone</p></li></ul>"))
    return table(spark, sf_dir, "pages").select("page_id", legal.risk_tips(html).alias("t")).select("page_id", legal.tips_text(F.col("t")).alias("tips"), F.size("t").alias("n"))


@query("""select doc_id, source as title, '# ' || source || chr(10) || '- status: ' || coalesce(lang, '') || '$1' || chr(10) || 'body' as stamped from documents""")
def heading_stamps(spark, sf_dir):
    """Heading-one titles, and a metadata line put in or replaced."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("# "), "source", F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "- status: old\n").otherwise(""), F.lit("body"))
    return d.select("doc_id", legal.heading_one(text).alias("title"), legal.stamped(text, "status", F.concat(F.coalesce("lang", F.lit("")), F.lit("$1"))).alias("stamped"))


@query("""select p_partkey, case when p_size % 3 = 0 then '第一条,第' || p_size || '条' when p_size % 3 = 1 then '2.' || p_size else '' end as range from part""")
def article_ranges(spark, sf_dir):
    """First and last article or number of a chunk."""
    size = F.col("p_size")
    text = F.when(size % 3 == 0, F.concat(F.lit("第一条 x\n第二条\n第"), size, F.lit("条"))).when(size % 3 == 1, F.concat(F.lit("2."), size, F.lit(" a\nno 3.1 here"))).otherwise("none")
    return _part(spark, sf_dir).select("p_partkey", F.array_join(legal.article_range(text), ",").alias("range"))
