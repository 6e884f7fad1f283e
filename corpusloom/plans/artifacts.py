"""Message traces, structured outputs, and what a batch leaves behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import messages
from corpusloom.operators import artifacts
from corpusloom.plans.registry import query
from corpusloom.sources.readers import table

_BLOCK = "struct<type:string,text:string,thinking:string>"
_MESSAGE = "struct<kind:string,name:string,artifact:string,calls:array<struct<name:string,args:string>>>"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("""select conv_id, string_agg(case when role <> 'user' and turn % 3 <> 1 then text end, '' order by turn) as said, coalesce(string_agg(case when role = 'user' or turn % 3 = 1 then text end, '' order by turn), '') as thought
from (select conv_id, turn, role, coalesce(text, '') as text from conversations) group by conv_id""".replace("select conv_id, string_agg(", "select conv_id, coalesce(string_agg(", 1).replace("end, '' order by turn) as said", "end, '' order by turn), '') as said", 1))
def content_flattened(spark, sf_dir):
    """Text and thoughts of message contents."""
    kind = F.when(F.col("role") == "user", "thinking").when(F.col("turn") % 3 == 1, "reasoning").otherwise("text")
    block = F.struct(kind.alias("type"), F.when(kind != "thinking", F.col("text")).alias("text"), F.when(kind == "thinking", F.col("text")).alias("thinking")).cast(_BLOCK)
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("b")).select("conv_id", F.transform("b", lambda x: x["b"]).alias("b"))
    return c.select("conv_id", messages.content_text(F.col("b")).alias("said"), messages.content_thoughts(F.col("b")).alias("thought"))


@query("""with e as (select user_id, event_id, event_type, value from events), r as (select user_id, max(event_id) filter (event_type = 'purchase' and event_id % 3 <> 0) as result, max(event_id) filter (event_type = 'click') as call from e group by user_id)
select user_id, coalesce(result, call) as submitted, result is null and call is null as retry from r""")
def submissions(spark, sf_dir):
    """What each trace submits: the last sound result of the tool, else the last call's arguments."""
    said = F.concat(F.lit('{"id": '), F.col("event_id"), F.lit("}"))
    none = F.array().cast("array<struct<name:string,args:string>>")
    made = F.struct(
        F.when(F.col("event_type") == "purchase", "tool").otherwise("model").alias("kind"),
        F.when(F.col("event_type") == "purchase", "submit").otherwise("other").alias("name"),
        F.when(F.col("event_id") % 3 == 0, "not json").otherwise(said).alias("artifact"),
        F.when(F.col("event_type") == "click", F.array(F.struct(F.lit("search").alias("name"), F.lit("{}").alias("args")), F.struct(F.lit("submit").alias("name"), said.alias("args")))).otherwise(none).alias("calls"),
    ).cast(_MESSAGE)
    traces = _events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", made.alias("m")))).alias("t")).select("user_id", F.transform("t", lambda x: x["m"]).alias("t"))
    got = messages.submission(F.col("t"), "submit", "id long")
    return traces.select("user_id", got["id"].alias("submitted"), got.isNull().alias("retry"))


_OPINION, _RISK = {"kind": ("gap", "risk")}, {"risk_level": ("none", "low", "high"), "affected_party": ("both", "third")}


@query("""select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 17 = 0 then 'no output' else concat_ws(',', case when l_returnflag = 'R' then 'missing has_opinion' end, case when l_linenumber = 3 then 'missing opinion.finding' end, case when l_returnflag = 'A' then 'unknown opinion.kind' end, case when l_discount * 20 > 1 then 'opinion.confidence out of range' end,
  case when l_linenumber % 2 = 0 then 'unknown risk.risk_level' end, case when l_tax * 20 > 1 then 'risk.confidence out of range' end) end as faults from lineitem""")
def output_faults(spark, sf_dir):
    """Outputs against their schema: values, ranges, what is missing (V5)."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    opinion = F.struct(F.when(F.col("l_returnflag") == "A", "noise").otherwise("gap").alias("kind"), F.when(F.col("l_linenumber") != 3, "found").alias("finding"), F.lit("do").alias("recommendation"), (F.col("l_discount") * 20).alias("confidence"))
    risk = F.struct(F.when(F.col("l_linenumber") % 2 == 0, "odd").otherwise("low").alias("risk_level"), F.lit("both").alias("affected_party"), F.lit("as seen").alias("rationale"), (F.col("l_tax") * 20).alias("confidence"))
    output = F.when(F.col("l_partkey") % 17 != 0, F.struct(F.when(F.col("l_returnflag") != "R", True).alias("has_opinion"), F.array(opinion).alias("opinions"), risk.alias("risk_assessment")))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(messages.output_faults(output, _OPINION, _RISK), ",").alias("faults"))


@query("""select c_custkey, count(o_orderkey) = 0 as settled, case when count(o_orderkey) = 0 then 'none' end as risk_level from customer left join orders on o_custkey = c_custkey group by c_custkey""")
def empty_consistency(spark, sf_dir):
    """Reviews without facts are settled without a model (V6)."""
    facts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("facts"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(facts, "c_custkey", "left")
    fixed = messages.empty_review(F.col("facts"))
    return c.select("c_custkey", fixed.isNotNull().alias("settled"), fixed["risk_level"].alias("risk_level"))


@query("""select p_partkey, case when p_size % 2 = 0 then p_name when p_size % 3 = 0 then p_brand end as taken, case when p_size % 2 = 0 then 1 else 2 end as attempts, case when p_size % 2 = 0 then '' when p_size % 3 = 0 then 'too small' else 'too small,too small' end as reasons from part""")
def attempts(spark, sf_dir):
    """Generated, validated, tried again, and rejected with reasons (V7)."""
    size = F.col("p_size")
    tries = F.array(F.struct((size % 2).alias("bad"), F.col("p_name").alias("text")), F.struct(F.when(size % 3 == 0, 0).otherwise(1).alias("bad"), F.col("p_brand").alias("text")))
    chosen = messages.last_attempt(tries, lambda a: F.when(a["bad"] == 1, F.array(F.lit("too small"))).otherwise(F.array().cast("array<string>")))
    return table(spark, sf_dir, "part").select("p_partkey", chosen.alias("c")).select("p_partkey", F.col("c.value.text").alias("taken"), "c.attempts", F.array_join("c.reasons", ",").alias("reasons"))


@query("""select event_id, '{"event":"' || event_type || '","at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","details":{' || case when user_id % 2 = 0 then '"run":"' || user_id || '",' else '' end || '"who":"' || event_id || '"}}' as line from events""")
def audit_log(spark, sf_dir):
    """One structured record for each event (Q10)."""
    line = messages.audit_record(F.col("event_type"), F.col("ts"), who=F.col("event_id"), run=F.when(F.col("user_id") % 2 == 0, F.col("user_id")))
    return _events(spark, sf_dir).select("event_id", line.alias("line"))


@query("""select l_orderkey, count(*) filter (l_linenumber % 4 <> 0) as n_blocks, coalesce(arg_min('H' || l_partkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) filter (l_returnflag = 'R' and l_linenumber % 4 <> 0), 'doc') as title, round(sum(l_quantity) filter (l_linenumber % 4 <> 0 and l_linestatus = 'O'), 4) as boxes,
  round(min(l_quantity), 4) as x1, round(max(l_tax), 4) as y2 from lineitem group by l_orderkey""")
def tree_blocks(spark, sf_dir):
    """Blocks of document trees with page and box, the title, and boxes around polygons."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    place = F.struct(F.col("l_linenumber").alias("page_no"), F.when(F.col("l_linestatus") == "O", F.array(F.col("l_quantity"), F.lit(0.0), F.lit(1.0), F.lit(2.0))).alias("bbox"))
    item = F.struct(F.when(F.col("l_returnflag") == "R", "SectionHeaderItem").otherwise("TextItem").alias("class"), F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit(" H"), F.col("l_partkey"))).otherwise(" ").alias("text"), F.array(place).alias("prov"))
    trees = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", item.alias("i")))).alias("t"), F.collect_list(F.array("l_quantity", "l_tax")).alias("p"))
    trees = trees.select("l_orderkey", messages.blocks_of(F.transform("t", lambda x: x["i"])).alias("b"), messages.polygon_box(F.col("p")).alias("box"))
    lefts = F.transform(F.filter("b", lambda b: b["box"].isNotNull()), lambda b: F.get(b["box"], F.lit(0)))
    total = F.when(F.size(lefts) > 0, F.round(F.aggregate(lefts, F.lit(0.0), lambda a, x: a + x), 4))
    return trees.select("l_orderkey", F.size("b").cast("long").alias("n_blocks"), messages.tree_title(F.col("b"), F.lit("doc"), 100).alias("title"), total.alias("boxes"), F.round(F.get("box", F.lit(0)), 4).alias("x1"), F.round(F.get("box", F.lit(3)), 4).alias("y2"))


@query("""select doc_id, source, lang from documents where source <> 'src1' union all select doc_id + 1000000, source, 'new' from documents where source = 'src1' and doc_id % 3 = 0""")
def keyed_replacement(spark, sf_dir):
    """All rows of the keys in a batch replaced by the batch's (K7)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return artifacts.replaced(d, d.filter("source = 'src1' and doc_id % 3 = 0").select(F.col("doc_id") + 1000000, "source", F.lit("new").alias("lang")).toDF("doc_id", "source", "lang"), "source")


@query("""with s as (select distinct source from documents union select 'nothing'), r as (select source, count(*) as n, bool_and(n_chars < 6000) as fine from documents group by source)
select s.source, case when r.n is null then 0 when fine then r.n else -1 end as n, coalesce(case when fine then r.n end, 0) as written from s left join r on s.source = r.source""")
def isolated_failures(spark, sf_dir):
    """Sources that fail don't take others with them (K8)."""
    d = table(spark, sf_dir, "documents")
    sources = d.select("source").union(spark.range(1).select(F.lit("nothing")))
    fine = F.col("n_chars") < 6000
    written = artifacts.sound_rows(d, "source", fine).groupBy("source").agg(F.count(F.lit(1)).alias("written"))
    return artifacts.isolated_counts(sources, d, "source", fine).join(written, "source", "left").na.fill(0, ["written"])


_KEY = """sha256('{"input":{"id":' || {id} || '},"model":"m\\"1","prompt_hash":"' || left(sha256('ask'), 16) || '","task":"' || {task} || '"}')"""


@query("with w as (select event_id, event_type as task, user_id, " + _KEY.replace("{id}", "user_id").replace("{task}", "event_type") + """ as key from events), c as (select distinct key from w where user_id % 3 = 0)
select w.task, count(*) filter (c.key is not null and w.task <> 'click') as hits, count(*) filter (c.key is null or w.task = 'click') as misses, count(distinct case when c.key is null or w.task = 'click' then w.key end) as writes from w left join c on w.key = c.key group by w.task""")
def result_cache(spark, sf_dir):
    """Content-addressed results: hits, misses and writes, with one task forced."""
    payload = F.to_json(F.struct(F.col("user_id").alias("id")))
    keyed = _events(spark, sf_dir).select("event_id", F.col("event_type").alias("task"), "user_id", artifacts.cache_key(F.col("event_type"), artifacts.prompt_hash(F.lit("ask")), payload, F.lit('m"1')).alias("key"))
    cache = keyed.filter("user_id % 3 = 0").select("key", F.lit("out").alias("output"), F.col("event_id").alias("created_at"))
    return artifacts.cache_stats(artifacts.cached(keyed.select("event_id", "key", "task"), cache, ("click",)))


@query("""select count(*) as n, count(*) filter (quality = 0) as n_0, count(*) filter (quality = 1) as n_1, count(*) filter (quality = 7) as n_7, true as same_in_any_order from labels""")
def run_manifest(spark, sf_dir):
    """Counts of a data set and a fingerprint of its ids that doesn't depend on their order."""
    labels = table(spark, sf_dir, "labels")
    one, other = (artifacts.manifest(rows, "quality", ["0", "1", "7"], "doc_id") for rows in (labels.withColumn("quality", F.col("quality").cast("string")), labels.withColumn("quality", F.col("quality").cast("string")).repartition(3, "quality")))
    return one.crossJoin(other.select(F.col("ids_sha256").alias("again"))).select("n", "n_0", "n_1", "n_7", (F.col("ids_sha256") == F.col("again")).alias("same_in_any_order"))


@query("""with f as (select p_partkey, case when p_partkey % 10 = 0 then '' else p_brand end as title, p_name || '_' || p_partkey as name, p_size > 25 as is_full, p_size as size from part),
k as (select *, first_value(name) over w as keep, first_value(is_full) over w as keep_full from f where title <> '' window w as (partition by title order by not is_full, size desc, name rows between unbounded preceding and unbounded following))
select title, name as "delete", keep, keep_full from k where name <> keep""")
def deletion_plan(spark, sf_dir):
    """Which duplicates a plan would delete, and what would stay."""
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 10 == 0, "").otherwise(F.col("p_brand")).alias("title"), F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("name"), "p_size")
    return artifacts.deletion_plan(p, "title", "name", F.col("p_size") > 25, F.col("p_size"))


@query("""select p_partkey, case when p_size % 2 = 0 then p_type else p_name end as page_content, p_name as display_text, p_brand as brand, '["' || p_type || '"]' as kinds, case when p_size % 3 = 0 then '' else p_size::varchar end as size from part""")
def vector_rows(spark, sf_dir):
    """Chunks as rows of a vector store."""
    p = table(spark, sf_dir, "part")
    chunks = p.select("p_partkey", F.col("p_name").alias("text"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("embedding_text"), F.col("p_brand").alias("brand"), F.array("p_type").alias("kinds"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("size"))
    rows = artifacts.vector_rows(chunks, "p_partkey")
    return rows.select("p_partkey", "page_content", "display_text", *(F.col("metadata")[n].alias(n) for n in ("brand", "kinds", "size")))


@query("""with s as (select user_id as session_id, user_id % 5 as user_id, min(ts) as updated_at from events group by user_id)
select e.event_id, s.user_id from events e join s on e.user_id = s.session_id where s.user_id = case when e.user_id % 2 = 0 then e.user_id % 5 else 9 end""")
def session_messages(spark, sf_dir):
    """Messages for who owns the session only."""
    e = _events(spark, sf_dir).withColumn("session_id", F.col("user_id"))
    sessions = e.select("session_id", (F.col("user_id") % 5).alias("user_id")).distinct()
    asked = sessions.select("session_id", F.when(F.col("session_id") % 2 == 0, F.col("session_id") % 5).otherwise(9).alias("user_id"))
    return artifacts.session_messages(sessions, e.drop("user_id"), asked).join(sessions, "session_id").select("event_id", "user_id")


@query("""select user_id as session_id, greatest(max(ts), timestamp '2024-01-10') as updated_at from events group by user_id""")
def sessions_touched(spark, sf_dir):
    """Sessions' times moved up to their newest message."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"))
    return artifacts.touched(e.select("session_id").distinct().withColumn("updated_at", F.to_timestamp(F.lit("2024-01-10"))), e)


@query("""select c_custkey, case c_mktsegment when 'BUILDING' then 'price,time' when 'MACHINERY' then 'quality' else 'other' end as dims from customer where c_nationkey = 3""")
def owned_focus(spark, sf_dir):
    """One owner's rows with their review dimensions."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("user_id"))
    return artifacts.owned(c, "3").select("c_custkey", F.array_join(artifacts.focus(F.col("c_mktsegment"), {"BUILDING": ("price", "time"), "MACHINERY": ("quality",)}, ("other",)), ",").alias("dims"))


@query(r"""select 'review_' || left(sha256('kb' || chr(10) || url || chr(10) || page_id || chr(10) || 'why'), 20) as review_id, url, page_id::varchar as title, 'why' as review_reason, length(html) as body_len from pages""")
def review_items(spark, sf_dir):
    """Routed rows in one review schema."""
    p = table(spark, sf_dir, "pages")
    items = artifacts.review_items(p, "kb", "layer", F.col("page_id").cast("string"), F.lit("why"), F.lit("review"), F.lit("quality"), F.col("html"))
    return items.select("review_id", "url", "title", "review_reason", "body_len")
