"""Joins, verification and relational semantics on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.operators import joins, store
from corpusloom.plans.registry import query
from corpusloom.sources.readers import table


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi_join(spark, sf_dir):
    """Rows with an accepted id."""
    return joins.accepted(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id")


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels) and doc_id not in (select doc_id from documents where doc_id % 9 = 0)")
def anti_join(spark, sf_dir):
    """Rows that no earlier output has."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return joins.unseen(d, table(spark, sf_dir, "labels"), d.filter("doc_id % 9 = 0"), key="doc_id")


@query("select d.doc_id, d.n_chars, l.quality, l.toxic from documents d join labels l on d.doc_id = l.doc_id")
def inner_join(spark, sf_dir):
    """Clauses with their accepted documents."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


@query("select d.doc_id, d.source, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id")
def enriched(spark, sf_dir):
    """Left enrichment by id."""
    return joins.enriched(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"])


@query("""select c_custkey, count(o_orderkey) as n_children, coalesce(string_agg(o_orderkey, ',' order by o_orderkey), '') as children from customer left join orders on o_custkey = c_custkey group by c_custkey""")
def nested_children(spark, sf_dir):
    """Parents with their children in order."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = joins.with_children(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "o_orderkey", ["o_orderstatus"], "kids")
    return c.select("c_custkey", F.size("kids").cast("long").alias("n_children"), F.array_join(F.transform("kids", lambda k: k["o_orderkey"].cast("string")), ",").alias("children"))


@query("""select c_custkey, (select o_orderkey from orders where o_custkey = c_custkey order by o_orderdate desc, o_orderkey desc limit 1) as latest_o_orderkey from customer""")
def latest_child(spark, sf_dir):
    """The newest child of each parent, null without one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return joins.latest_child(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "o_orderkey", "o_orderdate")


@query("""with o as (select o_custkey, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders group by o_custkey),
l as (select o_custkey, count(*) as n_lines, count(*) filter (l_returnflag = 'R') as n_returned from lineitem join orders on l_orderkey = o_orderkey group by o_custkey)
select c_custkey, coalesce(n_orders, 0) as n_orders, coalesce(total, 0) as total, coalesce(n_lines, 0) as n_lines, coalesce(n_returned, 0) as n_returned from customer left join o on o.o_custkey = c_custkey left join l on l.o_custkey = c_custkey""")
def report_assembly(spark, sf_dir):
    """A parent's report from several child tables (D10). Lines are summed by order before they meet customers."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    sums = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.sum("n").alias("n_lines"), F.sum("r").alias("n_returned"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(sums, "c_custkey", "left").na.fill(0)


_STORE = """store as (select n_nationkey as chunk_id, n_name || ' TRADE ACT' as law, (n_nationkey % 7 + 1)::varchar as article from nation
  union all select 100 + n_nationkey, 'ACT OF ' || r_name, (n_nationkey % 7 + 1)::varchar from nation join region on r_regionkey = n_regionkey
  union all select 200, 'TRADE', '8')"""


@query("with " + _STORE + """, cited as (select c_custkey as id, case c_custkey % 6 when 0 then n_name || ' TRADE ACT' when 1 then n_name when 2 then 'TRADE ACT' when 3 then '' when 4 then 'THE ACT OF ' || r_name || ' AS AMENDED' else 'nowhere' end as law,
  case when c_custkey % 2 = 0 then '第' || (c_nationkey % 7 + 1) || '条' else (c_custkey % 9 + 1)::varchar end as article from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey),
c as (select *, replace(law, ' ', '') as l, regexp_replace(article, '[第条]', '', 'g') as a from cited), s as (select chunk_id, replace(law, ' ', '') as l, article as a from store),
best as (select l, a, min(chunk_id) as chunk_id from s group by l, a),
pairs as (select distinct c.l, c.a from c), exact as (select p.l, p.a, b.chunk_id from pairs p join best b on p.l = b.l and p.a = b.a),
loose as (select p.l, p.a, count(*) as n, min(b.chunk_id) as chunk_id from pairs p join best b on p.a = b.a and (contains(b.l, p.l) or contains(p.l, b.l)) group by p.l, p.a having count(*) = 1)
select id, law, article, coalesce(e.chunk_id, f.chunk_id) is not null as verified, case when e.chunk_id is not null then 'exact' when f.chunk_id is not null then 'fuzzy' else 'none' end as how, coalesce(e.chunk_id, f.chunk_id) as chunk_id
from c left join exact e on c.l = e.l and c.a = e.a left join loose f on c.l = f.l and c.a = f.a""")
def verify_exact_fuzzy(spark, sf_dir):
    """Citations against the store, exactly and else by article and a law's name that contains the other's, if just one does."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    item = (F.col("n_nationkey") % 7 + 1).cast("string").alias("article")
    known = n.select(F.col("n_nationkey").cast("long").alias("chunk_id"), F.concat("n_name", F.lit(" TRADE ACT")).alias("law"), item)
    known = known.union(n.select(F.col("n_nationkey").cast("long") + 100, F.concat(F.lit("ACT OF "), "r_name"), item)).union(spark.range(1).select(F.lit(200).cast("long"), F.lit("TRADE"), F.lit("8"))).withColumn("article_text", F.lit(""))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.col("c_custkey") % 6
    law = F.when(kind == 0, F.concat("n_name", F.lit(" TRADE ACT"))).when(kind == 1, F.col("n_name")).when(kind == 2, "TRADE ACT").when(kind == 3, "").when(kind == 4, F.concat(F.lit("THE ACT OF "), "r_name", F.lit(" AS AMENDED"))).otherwise("nowhere")
    article = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("第"), (F.col("c_nationkey") % 7 + 1).cast("string"), F.lit("条"))).otherwise((F.col("c_custkey") % 9 + 1).cast("string"))
    cited = c.select(F.col("c_custkey").alias("id"), law.alias("law"), article.alias("article"))
    return joins.verify_citations(cited, known).drop("article_text")


@query("""select c_custkey, name, item, case when item < 0 then 'not_in_law' when name = 'nowhere' then 'not_in_store' else 'found' end as status from (
  select c_custkey, case when c_custkey % 5 = 0 then 'nowhere' else n_name end as name, case when c_custkey % 7 = 0 and c_custkey % 5 <> 0 then -1 else c_nationkey end as item from customer join nation on n_nationkey = c_nationkey)""")
def lookup_not_found(spark, sf_dir):
    """Lookups that say what is missing."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    wanted = c.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "nowhere").otherwise(F.col("n_name")).alias("name"), F.when((F.col("c_custkey") % 7 == 0) & (F.col("c_custkey") % 5 != 0), -1).otherwise(F.col("c_nationkey")).alias("item"))
    return joins.lookup_status(wanted, n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("item")), "name", "item")


@query("""select o_orderkey as scope, ref, case when ref = '1' then (select min(l_linenumber) from lineitem where l_orderkey = o_orderkey and l_linenumber = 1) when ref = 'R' then (select min(l_linenumber) from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') end as resolved from orders, (values ('1'), ('R'), ('zz')) r(ref)""")
def clause_reference(spark, sf_dir):
    """References resolved by exact name, then by other names in order."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scope"), "l_linenumber", "l_returnflag")
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scope"), F.explode(F.array(F.lit("1"), F.lit("R"), F.lit("zz"))).alias("ref"))
    return joins.resolve(refs, items, "scope", "ref", "l_linenumber", [F.col("l_returnflag")], "l_linenumber")


@query("""with tries as (select page_id, 0 as pos, url || '/missing' as url from pages union all select page_id, 1, url from pages)
select p.page_id, (select t.url from tries t join pages g on g.url = t.url where t.page_id = p.page_id and length(g.html) >= 500 order by pos limit 1) as source from pages p""")
def source_fallback(spark, sf_dir):
    """The first source whose page is long enough."""
    p = table(spark, sf_dir, "pages")
    rows = p.select("page_id", F.array(F.concat("url", F.lit("/missing")), "url").alias("urls"))
    return joins.fallback(rows, p.select("url", F.col("html").alias("body")), "page_id", "urls", 500).select("page_id", "source")


@query("""with a as (select doc_id, text from documents where doc_id % 2 = 0), b as (select doc_id // 2 * 2 as doc_id, text from documents where doc_id % 2 = 1)
select a.doc_id, greatest(length(a.text), coalesce(length(b.text), 0)) as n from a left join b on a.doc_id = b.doc_id""")
def longest_text_wins(spark, sf_dir):
    """Attachments replace texts only if longer."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    odd = d.filter("doc_id % 2 = 1").select((F.floor(F.col("doc_id") / 2) * 2).cast("long").alias("doc_id"), "text")
    return joins.longest_wins(d.filter("doc_id % 2 = 0"), odd, "doc_id", "text").select("doc_id", F.length("text").alias("n"))


_CHANGES = "with changes as (select o_orderkey, o_custkey, 'X' as o_orderstatus, o_totalprice + 1 as o_totalprice from orders where o_orderkey % 10 = 0 union all select -o_orderkey, o_custkey, 'N', o_totalprice from orders where o_orderkey % 10 = 1)"


def _changes(o):
    return o.filter("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")).withColumn("o_totalprice", F.col("o_totalprice") + 1).unionByName(o.filter("o_orderkey % 10 = 1").withColumn("o_orderkey", -F.col("o_orderkey")).withColumn("o_orderstatus", F.lit("N")))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(_CHANGES + " select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from (select * from changes union all select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_orderkey not in (select o_orderkey from changes)) group by o_orderstatus")
def upsert(spark, sf_dir):
    """Insert or update by key."""
    o = _orders(spark, sf_dir)
    out = store.upsert(o, _changes(o), ["o_orderkey"], "o_custkey")
    return out.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(_CHANGES + " select o_orderkey, o_orderstatus from (select o_orderkey, o_orderstatus from orders union all select o_orderkey, o_orderstatus from changes where o_orderkey not in (select o_orderkey from orders))")
def insert_ignore(spark, sf_dir):
    """Insert unless the key is there."""
    o = _orders(spark, sf_dir)
    return store.insert_ignore(o, _changes(o), ["o_orderkey"], [F.col("o_custkey")]).select("o_orderkey", "o_orderstatus")


@query("select o_orderkey, case when o_orderkey % 10 = 0 then 'U' else o_orderstatus end as o_orderstatus, o_totalprice from orders")
def partial_update(spark, sf_dir):
    """Null leaves a value as it is (D3)."""
    o = _orders(spark, sf_dir)
    changes = o.filter("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "U").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    return store.update(o, changes, "o_orderkey", ["o_orderstatus", "o_totalprice"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""select o_orderstatus as kept_status, min(o_orderkey) as o_orderkey, lower(o_orderpriority) as priority from orders group by o_orderstatus, lower(o_orderpriority)""")
def dedupe_delete(spark, sf_dir):
    """Keeps the least id of each key, with a case-normalised value."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("kept_status"), F.lower("o_orderpriority").alias("priority")).agg(F.min("o_orderkey").alias("o_orderkey"))


@query("""select 'customer' as name, count(*) as n from customer where c_nationkey <> 3 union all select 'orders', count(*) from orders where o_custkey in (select c_custkey from customer where c_nationkey <> 3) or o_custkey not in (select c_custkey from customer)
union all select 'lineitem', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3))""")
def cascade_delete(spark, sf_dir):
    """Deleting parents deletes what hangs on them."""
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem")}
    out = store.delete_cascade(t, {"orders": ("o_custkey", "customer", "c_custkey"), "lineitem": ("l_orderkey", "orders", "o_orderkey")}, "customer", t["customer"].filter("c_nationkey = 3").select("c_custkey"))
    rows = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in out.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""select 'status' as "constraint", count(*) filter (o_orderstatus not in ('F', 'O')) as violations from orders union all select 'price', count(*) filter (not o_totalprice > 1000) from orders
union all select 'one_order', count(*) - count(distinct o_custkey) from orders union all select 'customer', count(*) from orders where o_custkey not in (select c_custkey from customer)""")
def constraint_audit(spark, sf_dir):
    """Rows that break checks, uniqueness or references."""
    o = table(spark, sf_dir, "orders")
    return store.audit(o, {"status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice") > 1000}, {"one_order": ["o_custkey"]}, {"customer": ("o_custkey", table(spark, sf_dir, "customer"), "c_custkey")})


@query("""select doc_id, source, case when doc_id % 4 = 2 then 'existing' else 'generated' end as origin from documents""")
def dataset_merge(spark, sf_dir):
    """Two datasets by id, the generated row where both have it (E18): even ids exist, all but each second of those are generated."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return joins.merged_datasets(d.filter("doc_id % 2 = 0").withColumn("origin", F.lit("existing")), d.filter("doc_id % 4 <> 2").withColumn("origin", F.lit("generated")), "doc_id")


@query("""select doc_id, coalesce(n_chars, 0)::bigint as n_chars, 'active' as status, null::varchar as note, source from documents""")
def migrated_table(spark, sf_dir):
    """A table of an older shape in the newer one."""
    wanted = StructType([StructField("doc_id", LongType()), StructField("n_chars", LongType()), StructField("status", StringType()), StructField("note", StringType())])
    return store.migrated(table(spark, sf_dir, "documents").select("source", "n_chars", "doc_id"), wanted, {"status": "active"})


@query("""with o as (select max(o_orderkey) as last from orders)
select last + row_number() over (order by l_shipdate, l_orderkey, l_linenumber) as o_orderkey, l_shipdate as o_orderdate, l_orderkey, l_linenumber from lineitem, o""")
def insert_returning(spark, sf_dir):
    """Rows inserted with gapless keys after the table's greatest, and given back with them."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("o_orderdate"), "l_orderkey", "l_linenumber")
    return store.insert_returning(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), rows, "o_orderkey", ["o_orderdate", "l_orderkey", "l_linenumber"])[1]
