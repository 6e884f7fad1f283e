"""Keep-rules, numbering, segments, catalogs, indexes and percentiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import aggregates, joins, windows
from corpusloom.plans.registry import query
from corpusloom.sources.readers import table


@query("select source, min(doc_id) as doc_id, arg_min(n_chars, doc_id) as n_chars from documents group by source")
def dedupe_first(spark, sf_dir):
    """The first row of each natural key."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return windows.keep_first(d, ["source"], F.col("doc_id"))


@query("select lang, doc_id, n_chars from (select lang, doc_id, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id) as nth from documents) where nth = 1")
def dedupe_best(spark, sf_dir):
    """The best row of each key by several measures."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return windows.keep_least(d, ["lang"], [-F.col("n_chars"), F.col("doc_id")])


@query("select md5(text) as text_md5, min(doc_id) as doc_id, count(*) as copies from documents group by text having count(*) > 1")
def dedupe_exact_text(spark, sf_dir):
    """Groups of equal texts, by hash."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query("select count(*) - count(distinct source) as dropped from documents")
def dedupe_dropped(spark, sf_dir):
    """How many rows a keep-rule drops."""
    d = table(spark, sf_dir, "documents")
    return d.agg(windows.keep_first_count(d, ["source"]).alias("dropped"))


@query("""select doc_id, case when n_chars < 300 then 'rejected' when row_number() over (partition by source, n_chars >= 300 order by n_chars desc, doc_id) = 1 then 'main' else 'review' end as route from documents""")
def route_duplicates(spark, sf_dir):
    """Later included rows of a key go to review."""
    d = table(spark, sf_dir, "documents")
    return windows.route_duplicates(d, "source", F.col("n_chars") >= 300, [-F.col("n_chars"), F.col("doc_id")]).select("doc_id", "route")


@query("""with d as (select doc_id, case when doc_id % 5 = 0 then '' else source end as k, case when doc_id % 3 = 0 then '' else lang end as b from documents)
select doc_id from d where k = '' union all select doc_id from (select doc_id, row_number() over (partition by k order by b = '', doc_id) as nth from d where k <> '') where nth = 1""")
def dedupe_with_body(spark, sf_dir):
    """The first row with a body of each key; rows without a key stay."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("k"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("b"))
    return windows.keep_with_body(d, "k", "b", F.col("doc_id")).select("doc_id")


@query("""select o_custkey, arg_min(o_orderpriority, o_orderkey) filter (o_orderkey % 4 <> 0) as o_orderpriority, arg_min(o_orderstatus, o_orderkey) as o_orderstatus from orders group by o_custkey""")
def merge_coalesce(spark, sf_dir):
    """One row of a key, each field its first present value."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).otherwise("").alias("o_orderpriority"), "o_orderstatus")
    return windows.coalesced(o, "o_custkey", ["o_orderpriority", "o_orderstatus"], "o_orderkey")


@query("""select conv_id, turn, lag(turn) over w as previous, lead(turn) over w as next, concat_ws(',', lag(turn) over w, lead(turn) over w) as neighbours from conversations window w as (partition by conv_id order by turn)""")
def neighbors(spark, sf_dir):
    """Ids before and after within a document."""
    c = windows.neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn", "turn")
    return c.select("conv_id", "turn", "previous", "next", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query("""select conv_id, turn, row_number() over (partition by conv_id order by turn) as nth, count(*) over (partition by conv_id) as total, 'c' || conv_id || '__' || lpad((row_number() over (partition by conv_id order by turn))::varchar, 4, '0') as item_id from conversations""")
def numbered_chunks(spark, sf_dir):
    """Row numbers, totals and ids."""
    return windows.numbered(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "c").select("conv_id", "turn", "nth", "total", "item_id")


@query("""with s as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as segment from conversations)
select conv_id, segment, string_agg(text, chr(10) order by turn) as text, count(*) as n_rows from s group by conv_id, segment""")
def segments(spark, sf_dir):
    """Segments that begin at marker rows."""
    s = windows.segments(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return windows.joined(s, ["conv_id", "segment"], "turn", "text")


@query("""with c as (select *, length(text) as n from conversations where length(text) >= 60), m as (select *, n < 120 or (n < 300 and role = 'user') as merges, row_number() over (partition by conv_id order by turn) as nth from c),
s as (select *, sum(case when not merges or nth = 1 then 1 else 0 end) over (partition by conv_id order by turn) as segment from m)
select conv_id, segment, string_agg(text, chr(10) order by turn) as text, arg_min(n, turn) as weight, count(*) as merged_from from s group by conv_id, segment""")
def short_merge(spark, sf_dir):
    """Short rows merged into the row before them."""
    c = table(spark, sf_dir, "conversations").withColumn("weight", F.length("text"))
    return windows.merge_short(c, "conv_id", "turn", "text", F.col("role") == "user", "weight", 60, 120, 300)


@query("""with c as (select *, case when role = 'system' then 1 when role = 'user' then 2 end as level from conversations),
s as (select *, max(case when level = 1 then turn end) over w as t1, max(case when level = 2 then turn end) over w as t2 from c window w as (partition by conv_id order by turn))
select conv_id, turn, concat_ws(' > ', case when t1 is not null then 'system' || t1 end, case when t2 > coalesce(t1, -1) then 'user' || t2 end) as path from s""")
def section_path(spark, sf_dir):
    """Headings in force at each row."""
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("level", F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2)).withColumn("heading", F.concat("role", F.col("turn").cast("string")))
    return windows.carry_path(c, "conv_id", "turn", "level", "heading", 2).select("conv_id", "turn", "path")


@query("select conv_id, turn, 1 + coalesce(sum(length(text) % 4) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from conversations")
def citation_offset(spark, sf_dir):
    """Running offsets of citations."""
    return windows.running_offset(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text") % 4).select("conv_id", "turn", F.col("offset").cast("long").alias("offset"))


@query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as last from events) where last is null or last <> event_type")
def drop_repeats(spark, sf_dir):
    """Without rows that repeat the row before them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return windows.drop_repeats(table(spark, sf_dir, "events"), w, "event_type").select("event_id", "user_id", "event_type")


@query("select doc_id, source, nth from (select doc_id, source, row_number() over (partition by source order by n_chars desc, doc_id) as nth from documents) where nth <= 3")
def caps(spark, sf_dir):
    """At most three rows of each group."""
    d = table(spark, sf_dir, "documents")
    return windows.capped(d, "source", [F.desc("n_chars"), F.col("doc_id")], 3).select("doc_id", "source", "nth")


@query("""select o_orderkey, o_orderpriority from orders order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 99 end, o_totalprice desc, o_orderkey limit 20""")
def top_k_priority(spark, sf_dir):
    """The first rows by a priority map, a measure and a key (O1)."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(99)
    return table(spark, sf_dir, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority")


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 100")
def newest_first(spark, sf_dir):
    """Newest rows with a limit (O3)."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_orderdate")


@query("""with c as (select lang, n_chars, row_number() over (partition by lang order by n_chars) as nth, count(*) over (partition by lang) as n from documents)
select lang, max(n) as n, min(n_chars) as least, max(n_chars) as most, min(n_chars) filter (nth = least(n - 1, floor(n * 0.5)::bigint) + 1) as p50, min(n_chars) filter (nth = least(n - 1, floor(n * 0.95)::bigint) + 1) as p95,
count(*) filter (n_chars > 1500) as over_budget from c group by lang""")
def positional_percentiles(spark, sf_dir):
    """Percentiles by position and rows over a budget."""
    d = table(spark, sf_dir, "documents").select("lang", "n_chars")
    return aggregates.positional_percentiles(d, ["lang"], "n_chars", [0.5, 0.95], 1500).withColumn("over_budget", F.col("over_budget").cast("long"))


@query("""with d as (select *, len(string_split(text, chr(10))) as paragraphs from documents)
select count(*) as n_docs, min(paragraphs) as paragraphs_min, max(paragraphs) as paragraphs_max, round(avg(paragraphs), 6) as paragraphs_avg, count(*) filter (contains(text, '|')) as with_table, count(*) filter (contains(text, 'License')) as with_licence from d""")
def doc_profile(spark, sf_dir):
    """Document profile."""
    d = table(spark, sf_dir, "documents")
    return aggregates.profile(d, {"paragraphs": F.size(F.split("text", "\n"))}, {"table": F.contains("text", F.lit("|")), "licence": F.contains("text", F.lit("License"))})


@query("""select concat_ws('|', contains(text, '|'), contains(text, '%%%'), least(len(string_split(text, chr(10))), 9)) as shape, count(*) as n from documents group by shape""")
def doc_shapes(spark, sf_dir):
    """Structure fingerprints and how many documents have each."""
    d = table(spark, sf_dir, "documents")
    return aggregates.shapes(d, table=F.contains("text", F.lit("|")), junk=F.contains("text", F.lit("%%%")), lines=F.least(F.size(F.split("text", "\n")), F.lit(9)))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by all")
def histograms(spark, sf_dir):
    """Group counts."""
    return aggregates.histogram(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("""select conv_id, arg_min(role, turn) as title, string_agg(text, chr(10) order by turn) as body, count(*) as n_parts from conversations group by conv_id""")
def group_concat(spark, sf_dir):
    """Texts of a document in order with its title (A10)."""
    return aggregates.group_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", ["role"])


@query("""with e as (select user_id, event_type, min(event_id) as pos from events group by all)
select event_type as key, string_agg(user_id::varchar, ',' order by pos, user_id) as items, count(*) as n_items from e group by event_type""")
def inverted_index(spark, sf_dir):
    """Items of each key in order of first mention."""
    e = aggregates.inverted(table(spark, sf_dir, "events"), "event_type", "user_id", F.col("event_id"))
    return e.select(F.col("event_type").alias("key"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "n_items")


@query("""select o_custkey, count(*) as n_rows, arg_min(o_orderpriority, o_orderkey) filter (o_orderkey % 3 <> 0) as o_orderpriority, arg_min(o_orderstatus, o_orderkey) as o_orderstatus from orders group by o_custkey""")
def catalog_summary(spark, sf_dir):
    """Row counts and first present values of each key."""
    o = table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise(""))
    return aggregates.catalog(o, "o_custkey", ["o_orderpriority", "o_orderstatus"], "o_orderkey")


@query("select distinct p_brand, p_type from part")
def distinct_pairs(spark, sf_dir):
    """Distinct values."""
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@query("""select p_partkey, left(md5(p_brand || '|' || p_type), 12) as group_id, row_number() over (partition by p_brand, p_type order by p_partkey) as variant, count(*) over (partition by p_brand, p_type) as n_variants from part""")
def variant_groups(spark, sf_dir):
    """Numbered variants of groups."""
    return aggregates.variants(table(spark, sf_dir, "part"), ["p_brand", "p_type"], ["p_partkey"]).select("p_partkey", "group_id", "variant", "n_variants")


@query("""select o_orderkey, count(l.l_linenumber) as citations, count(*) filter (l.l_returnflag = 'R') as verified from orders o left join lineitem l on l.l_orderkey = o.o_orderkey group by o_orderkey""")
def nested_citation_counts(spark, sf_dir):
    """Counts over nested arrays."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", (F.col("l_returnflag") == "R").alias("verified"))
    o = joins.with_children(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "l_linenumber", ["verified"], "citations")
    n, ok = aggregates.nested_counts(F.array(F.struct("citations")))
    return o.select("o_orderkey", n.cast("long").alias("citations"), ok.cast("long").alias("verified"))


@query("""select doc_id from documents where n_chars > 2000 union select doc_id from labels where toxic = 1""")
def set_union(spark, sf_dir):
    """Union of keys."""
    return table(spark, sf_dir, "documents").filter("n_chars > 2000").select("doc_id").union(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")).distinct()


@query("""select doc_id from documents except select doc_id from labels""")
def set_difference(spark, sf_dir):
    """Keys that are missing."""
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("""with d as (select conv_id, list_distinct(list(role)) as roles from conversations group by conv_id) select conv_id, len(roles) as n_roles, list_contains(roles, 'system') and list_contains(roles, 'user') as covers from d""")
def set_subset(spark, sf_dir):
    """Distinct lists and subset tests."""
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    wanted = F.array(F.lit("system"), F.lit("user"))
    return d.select("conv_id", F.size("roles").cast("long").alias("n_roles"), (F.size(F.array_except(wanted, "roles")) == 0).alias("covers"))
