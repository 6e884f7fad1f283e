"""What a crawl of the pages table gets to and lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.operators import frontier, records
from corpusloom.plans.registry import query
from corpusloom.sources import sinks
from corpusloom.sources.readers import table

_KEY = "regexp_replace(regexp_replace(trim({0}), '#.*$', ''), '^https://', 'http://', 'i')"
_LINKS = """l as (select page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?href\\s*=\\s*["'']([^"''#]+)["'']', 1)) as link from pages),
a as (select distinct KEY as node, regexp_replace(regexp_extract(url, '^([a-z]+://[^/]+)', 1) || link, '^https://', 'http://', 'i') as to_ from l where starts_with(link, '/') and not starts_with(link, '//'))""".replace("\\\\", "\\").replace("KEY", _KEY.format("url"))


@query("with recursive " + _LINKS + """, e as (select node, to_ from a union select to_, node from a),
s as (select min_by(KEY, page_id) as node from pages group by regexp_extract(url, '^[a-z]+://([^/]+)', 1)),
r(node, depth) as (select node, 0 from s union select e.to_, r.depth + 1 from r join e on e.node = r.node where r.depth < 50)
select node, min(depth) as depth from r group by node""".replace("KEY", _KEY.format("url")))
def crawl_reached(spark, sf_dir):
    """From each site's first page over shared links, both ways, to all that they lead to."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    links = frontier.page_links(pages)
    both = links.unionByName(links.select(F.col("to").alias("node"), F.col("node").alias("to")))
    first = pages.groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(F.min_by("url", "page_id").alias("url"))
    return frontier.reached(first.select(frontier.same_page(F.col("url")).alias("node")), both)


@query(r"""with t as (select page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"''#]+)["''][^>]*>(.*?)</a>', 1)) as link, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"''#]+)["''][^>]*>(.*?)</a>', 2)) as inner_, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"''#]+)["''][^>]*>(.*?)</a>', 1), 1) as pos from pages),
c as (select page_id, pos, url as list_url, regexp_replace(regexp_extract(url, '^([a-z]+://[^/]+)', 1) || link, '^https://', 'http://', 'i') as url, trim(regexp_replace(regexp_replace(inner_, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as title from t)
select url, title, list_url from (select *, row_number() over (partition by url order by page_id, pos) as k from c where length(title) >= 4) where k = 1""")
def crawl_listed(spark, sf_dir):
    """The details that list pages point to, each once."""
    return frontier.listed(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")


@query("""with p as (select page_id, KEY as start from pages), j as (select *, if(contains(start, '?'), '&', '?') as joint from p)
select page_id, unnest([start] || list_transform(range(0, 6), lambda k: start || joint || ['page', 'PageIndex', 'p'][k % 3 + 1] || '=' || (k // 3 + 1))) as url from j""".replace("KEY", _KEY.format("url")))
def crawl_probes(spark, sf_dir):
    """Guessed URLs of further pages of a list."""
    start = frontier.same_page(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(frontier.probes(start, ("page", "PageIndex", "p"), 2)).alias("url"))


@query("""select doc_id, lang as lang_known, case when doc_id % 4 = 1 then null else n_chars end as n_known,
case when doc_id % 4 = 1 then 'n/' || n_chars end as n_rescued, source as source_rescued, false as malformed from documents
union all select event_id, null, null, null, null, true from events""")
def rescued_fields(spark, sf_dir):
    """JSON records by a schema; unknown fields, values that don't fit it, and what is no record aren't lost (E5)."""
    d = table(spark, sf_dir, "documents")
    size = F.when(F.col("doc_id") % 4 == 1, F.to_json(F.struct("lang", F.concat(F.lit("n/"), "n_chars").alias("n"), "source"))).otherwise(F.to_json(F.struct("lang", F.col("n_chars").alias("n"), "source")))
    broken = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit("{"), "event_type").alias("json"))
    rows = records.decoded(d.select("doc_id", size.alias("json")).unionByName(broken), "json", StructType([StructField("lang", StringType()), StructField("n", LongType())]))
    part = lambda n: F.try_element_at("rescued", F.lit(n))
    return rows.select("doc_id", F.col("record.lang").alias("lang_known"), F.col("record.n").alias("n_known"), part("n").alias("n_rescued"), part("source").alias("source_rescued"), "malformed")


@query("""select doc_id, case when doc_id % 3 = 0 or doc_id % 5 = 0 then text else source end as holding, case when doc_id % 3 = 0 or doc_id % 5 = 0 then lang end as court, doc_id % 3 = 0 or doc_id % 5 = 0 as content_full from documents""")
def case_records(spark, sf_dir):
    """Records of a list with their contents, partial ones beyond the quota, settled against a second visit (E5)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    items = d.select("doc_id", F.col("source").alias("holding"))

    def visit(answers):
        full = F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.struct(F.col("text").alias("gist"), F.col("lang").alias("court")).alias("data")).alias("data")))
        response = F.when(answers, full).otherwise(F.lit('{"code": 500, "msg": "quota", "data": null}'))
        return records.with_content(items, d.select("doc_id", response.alias("response")), "doc_id", {"holding": "gist", "court": "court"})

    return records.settled(visit(F.col("doc_id") % 3 == 0), visit(F.col("doc_id") % 5 == 0), "doc_id")


@query("""select source, count(*) as n, sum(coalesce(n_chars, 0))::bigint as chars, (select count(*) from documents) as observed_rows, (select count(*) from documents where n_chars < 500) as observed_short from documents group by source""")
def observed_write(spark, sf_dir):
    """A table with counts that come from the pass that writes it (V4, K8)."""
    folder = sinks.work_folder(spark, "observed")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    seen = sinks.written(d, folder, short=F.count_if(F.col("n_chars") < 500))
    sums = spark.read.parquet(folder).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))
    return sums.select("*", F.lit(seen["rows"]).cast("long").alias("observed_rows"), F.lit(seen["short"]).cast("long").alias("observed_short"))
