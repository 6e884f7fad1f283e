"""Text functions, citations, HTML, numerals, identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.functions import numerals, text
from corpusloom.plans.registry import query
from corpusloom.sources import html, readers, sinks
from corpusloom.sources.readers import table
from corpusloom.streaming import events


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query(r"""select doc_id, regexp_replace(regexp_replace(text, '[\s\x0B]+', ' ', 'g'), '^ | $', '', 'g') as line, length(regexp_replace(text, '[\s\x0B]+', '', 'g')) as compact_chars from documents""")
def clean_line(spark, sf_dir):
    """White space collapsed and removed (F1)."""
    return _docs(spark, sf_dir).select("doc_id", text.clean_line(F.col("text")).alias("line"), F.length(text.compact(F.col("text"))).cast("long").alias("compact_chars"))


@query(r"""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[\s\x0B]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '') as lines from documents)
select doc_id, array_to_string(list_filter(lines, lambda x: not starts_with(x, 'Licensed') and not contains(x, ' | ')), chr(10)) as text from l""")
def noise_lines(spark, sf_dir):
    """Text without noise lines."""
    return _docs(spark, sf_dir).select("doc_id", text.drop_lines(F.col("text"), prefixes=("Licensed",), containing=(" | ",)).alias("text"))


@query("""select doc_id, octet_length(encode(text)) as n_bytes, case when octet_length(encode(coalesce(text, ''))) <= 40 then coalesce(text, '')
  else left(text, list_max(list_filter(range(41), lambda k: octet_length(encode(left(text, k))) <= 40))) || '...' end as head from documents""")
def byte_truncate(spark, sf_dir):
    """UTF-8 byte truncation with a mark."""
    return _docs(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), text.truncate_bytes(F.col("text"), 40, "...").alias("head"))


@query("""select doc_id, 'd_' || left(sha256(lang || chr(10) || source), 20) as id, md5(text) as text_md5 from documents""")
def stable_ids(spark, sf_dir):
    """Stable ids by hash."""
    return _docs(spark, sf_dir).select("doc_id", text.stable_id("d", F.col("lang"), F.col("source")).alias("id"), F.md5("text").alias("text_md5"))


@query(r"""select p_partkey, lower(regexp_replace(regexp_replace(p_name || ' (2020年)', '[\s\x0B]+', '', 'g'), '[()_-]|\d{4}年', '', 'g')) as title from part""")
def normalized_titles(spark, sf_dir):
    """Titles as keys (F16)."""
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_title(F.concat("p_name", F.lit(" (2020年)"))).alias("title"))


@query("""select p_partkey, case when p_size % 3 = 0 then '未命名' when length(p_brand) <= length(p_type) or p_size % 2 = 0 then p_brand else p_type end as title from part""")
def best_titles(spark, sf_dir):
    """The best of several titles."""
    p = table(spark, sf_dir, "part")
    none = F.col("p_size") % 3 == 0
    pick = text.best_title([F.when(none, "").otherwise(F.col("p_brand")), F.when(none | (F.col("p_size") % 2 == 0), None).otherwise(F.col("p_type"))])
    return p.select("p_partkey", pick.alias("title"))


@query("""select page_id, array_to_string(list_distinct_ordered, ' ') as links, len(list_distinct_ordered) as n_links from (
  select page_id, list_filter(l, lambda x, i: list_position(l, x) = i) as list_distinct_ordered from (select page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?href\\s*=\\s*["'']([^"''#]+)["'']', 1) as l from pages))""".replace("\\\\", "\\"))
def html_links(spark, sf_dir):
    """Distinct links of pages in order."""
    p = table(spark, sf_dir, "pages").select("page_id", html.links(F.col("html")).alias("l"))
    return p.select("page_id", F.array_join("l", " ").alias("links"), F.size("l").cast("long").alias("n_links"))


@query(r"""select page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', '', 'g'), '<[^>]*>', '', 'g'), '[\s\x0B]+', '', 'g')) as visible_chars from pages""")
def html_text(spark, sf_dir):
    """Visible characters of pages, entities as they are."""
    stripped = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</\1>", ""), "<[^>]*>", "")
    return table(spark, sf_dir, "pages").select("page_id", F.length(F.regexp_replace(stripped, r"\s+", "")).cast("long").alias("visible_chars"))


@query()
def html_main_text(spark, sf_dir):
    """The longest container's text of each page (F6); an element tree isn't SQL's."""
    p = html.with_main_text(table(spark, sf_dir, "pages"))
    return p.select("page_id", "main_text", html.plain(F.col("html")).alias("plain"))


@query(r"""select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host from pages""")
def field_extraction(spark, sf_dir):
    """Fields by patterns, the first that hits."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.first_match(F.col("html"), "(?is)<title[^>]*>(.*?)</title>").alias("title"), text.first_match(F.col("url"), "^[a-z]+://([^/]+)").alias("host"))


@query("""select event_id, coalesce(json_extract_string(props, '$.k')::bigint, -1) as k, case when event_id % 2 = 0 then 2 else 0 end as n from events""")
def event_props(spark, sf_dir):
    """Tolerant JSON decoding."""
    e = table(spark, sf_dir, "events")
    listed = text.json_list(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["a", "'), F.col("event_type"), F.lit('"]'))).otherwise("oops"))
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(-1)).alias("k"), F.size(listed).alias("n"))


@query("""select p_partkey, case when length(p_name) <= 12 then p_name else rtrim(left(p_name, 12)) end as short, case when p_size > 25 then 'size：' || p_size || '、' || p_brand end as label from part""")
def excerpts(spark, sf_dir):
    """Excerpts and labelled joins."""
    p = table(spark, sf_dir, "part")
    values = F.when(F.col("p_size") > 25, F.array(F.col("p_size").cast("string"), F.col("p_brand"))).otherwise(F.array(F.lit("")))
    return p.select("p_partkey", text.excerpt(F.col("p_name"), 12, ("\x01",), 5).alias("short"), text.labelled_join("size", values).alias("label"))


@query("""select p_partkey, concat_ws(chr(10), nullif(p_name, ''), case when p_size % 2 = 0 then p_brand end, p_type) as embedding_text from part""")
def embedding_templates(spark, sf_dir):
    """Templates of present parts."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.template(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""), F.col("p_type")).alias("embedding_text"))


_SPOKEN = """with recursive d(i, name) as (values (0, '零'), (1, '一'), (2, '二'), (3, '三'), (4, '四'), (5, '五'), (6, '六'), (7, '七'), (8, '八'), (9, '九')),
small as (select i.n, case when i.n = 0 then '零' else regexp_replace(regexp_replace(
    case when th.i > 0 then th.name || '千' else '零' end || case when hu.i > 0 then hu.name || '百' else '零' end || case when te.i > 0 then te.name || '十' else '零' end || case when o.i > 0 then o.name else '零' end,
    '零+', '零', 'g'), '^零|零$', '', 'g') end as said
  from range(10000) i(n), d th, d hu, d te, d o where th.i = i.n // 1000 and hu.i = i.n // 100 % 10 and te.i = i.n // 10 % 10 and o.i = i.n % 10)"""


@query(_SPOKEN + """, n as (select p_partkey, (p_partkey * 7919 % 9999 + 1)::bigint as n, case when p_size % 3 = 0 then (p_size % 20 + 1)::bigint end as more, (p_partkey * 104729 % 990000 + 10000)::bigint as large from part)
select p_partkey, n, '第' || regexp_replace(a.said, '^一十', '十') || '条' || coalesce('之' || regexp_replace(m.said, '^一十', '十'), '') as name, n || coalesce('之' || more, '') as key, n as back, large as large_back
from n join small a using (n) left join small m on m.n = n.more""")
def numeral_roundtrip(spark, sf_dir):
    """Article numbers up to 9999 with supplements in Chinese numerals and back, and numerals up to 999 999."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 9999 + 1).cast("long").alias("n"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") % 20 + 1).cast("long").alias("more"), (F.col("p_partkey") * 104729 % 990000 + 10000).cast("long").alias("large"))
    given = F.concat(F.col("n").cast("string"), F.when(F.col("more").isNotNull(), F.concat(F.lit("之"), F.col("more").cast("string"))).otherwise(""))
    rest = F.col("large") % 10000
    spoken = F.concat(numerals.from_int(F.floor(F.col("large") / 10000)), F.lit("万"), F.when((rest > 0) & (rest < 1000), "零").otherwise(""), F.when(rest > 0, F.regexp_replace(numerals.from_int(rest), "^十", "一十")).otherwise(""))
    p = p.withColumn("name", numerals.article_name(given))
    return p.select("p_partkey", "n", "name", numerals.article_key(F.col("name")).alias("key"), numerals.to_int(numerals.from_int(F.col("n"))).alias("back"), numerals.to_int(spoken).alias("large_back"))


@query("""select l_orderkey, l_linenumber, '合同法' as law, '第' || l_linenumber || '条' as article from lineitem union all select l_orderkey, l_linenumber, 'P' || l_partkey, null from lineitem""")
def citation_extract(spark, sf_dir):
    """Citations of laws and articles."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    said = F.concat(F.lit("依《中华人民共和国合同法》第"), F.col("l_linenumber").cast("string"), F.lit("条和《P"), F.col("l_partkey").cast("string"), F.lit("》"))
    return l.select("l_orderkey", "l_linenumber", F.inline(text.citations(said)))


@query(r"""select p_partkey, regexp_extract(f, '^(.+)_(\d{8})$', 1) as name, regexp_extract(f, '_(\d{8})$', 1) as version, '2024-01-' || lpad((p_size % 28 + 1)::varchar, 2, '0') as date, case when p_size % 2 = 0 then 'ocr' else 'document' end as parser
from (select p_partkey, p_size, p_brand || '_202401' || lpad((p_size % 28 + 1)::varchar, 2, '0') as f from part)""")
def file_names(spark, sf_dir):
    """File names taken apart and dispatched."""
    p = table(spark, sf_dir, "part")
    f = F.concat("p_brand", F.lit("_202401"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), F.when(F.col("p_size") % 2 == 0, ".png").otherwise(".docx"))
    name, version, date = text.file_parts(f)
    return p.select("p_partkey", name.alias("name"), version.alias("version"), date.alias("date"), text.parser_for(f).alias("parser"))


@query("""select p_partkey, case p_size % 4 when 0 then 'docx' when 1 then 'doc' when 2 then 'pdf' else 'other' end as kind from part""")
def file_kinds(spark, sf_dir):
    """File kinds by first bytes."""
    magic = F.array(*(F.unhex(F.lit(x)) for x in ("504B0304FF", "D0CF11E0A1", "255044462D", "4142434445")))
    return table(spark, sf_dir, "part").select("p_partkey", text.file_kind(F.get(magic, F.col("p_size") % 4)).alias("kind"))


@query("""select event_id, strftime(ts - interval 8 hour, '%Y-%m-%dT%H:%M:%SZ') as utc from events""")
def utc_times(spark, sf_dir):
    """Local times as UTC text."""
    return table(spark, sf_dir, "events").select("event_id", text.utc_iso(F.col("ts"), "+08:00").alias("utc"))


@query("""select l_orderkey, min(l_linenumber) as x1, min(l_quantity) as y1, max(l_linenumber + 1.0) as x2, max(l_quantity + 1.0) as y2 from lineitem group by l_orderkey""")
def box_union(spark, sf_dir):
    """The box around boxes."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    box = F.array(F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double"), F.col("l_linenumber") + 1.0, F.col("l_quantity") + 1.0)
    b = l.groupBy("l_orderkey").agg(text.box_union(F.collect_list(box)).alias("b"))
    return b.select("l_orderkey", *(F.get("b", F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))


@query("""select doc_id, source, coalesce(lang, '') as lang, n_chars::varchar as n_chars from documents order by doc_id limit 80""")
def preview(spark, sf_dir):
    """The first 80 rows, CSV-ready (K3, K5)."""
    first, _ = sinks.preview(_docs(spark, sf_dir).drop("text"), ["doc_id"])
    return sinks.csv_ready(first).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("""select p_partkey, length('{"p_name":"' || p_name || '","p_brand":"' || p_brand || '"}') > 50 as truncated from part""")
def bounded_artifacts(spark, sf_dir):
    """JSON over a size as its front."""
    j = text.bounded_json(F.struct("p_name", "p_brand"), 50)
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.get_json_object(j, "$.truncated") == "true", F.lit(False)).alias("truncated"))


@query("""select p_partkey, case when p_size % 2 = 0 then p_name || chr(10) || p_type else p_name end as kept from part""")
def garbage_lines(spark, sf_dir):
    """Text without lines of odd characters."""
    p = table(spark, sf_dir, "part")
    lines = F.concat("p_name", F.lit("\n☃☃☃☃ a\n###\n"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("☃☃"))
    return p.select("p_partkey", text.drop_garbage(lines).alias("kept"))


@query("""select p_partkey, case p_size % 3 when 0 then p_brand when 1 then p_type else '' end as maker, case when p_size % 2 = 0 then p_name else 'no break ' || p_name end as body from part""")
def labelled_values(spark, sf_dir):
    """Values after labels, on their line or the next, and bodies after a blank line."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    said = F.concat(F.lit("x: 1\n"), F.when(size % 3 == 0, F.concat(F.lit("maker： "), "p_brand")).when(size % 3 == 1, F.concat(F.lit("maker:\n\n "), "p_type", F.lit(" "))).otherwise("makers none"), F.lit("\nend"))
    chunk = F.when(size % 2 == 0, F.concat(F.lit("head\n\n"), "p_name")).otherwise(F.concat(F.lit("no break "), "p_name"))
    return p.select("p_partkey", text.label_value(said, "maker").alias("maker"), text.body_of(chunk).alias("body"))


@query("""select p_partkey, '《' || p_brand || '》第一条' || case when p_size % 2 = 0 then chr(10) || '第' || p_size || '条' else '' end as statutes from part""")
def statute_fields(spark, sf_dir):
    """The statute field of a case up to where citations end."""
    rest = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\n第"), "p_size", F.lit("条\n一审：某判决第二条"))).otherwise("\nnothing is cited\n第三条")
    return table(spark, sf_dir, "part").select("p_partkey", text.statute_lines(F.concat(F.lit("《"), "p_brand", F.lit("》第一条"), rest)).alias("statutes"))


@query("""select p_partkey, p_name || '。|' || p_type || '？|' || p_brand as sentences, case when p_size % 2 = 0 then 'x第一条 ' || p_brand || '|第二条 ' || p_type else '第一条 ' || p_brand || '|第二条 ' || p_type end as articles from part""")
def sentences_and_articles(spark, sf_dir):
    """Sentences with their marks, and lines with several articles."""
    p = table(spark, sf_dir, "part")
    said = F.concat("p_name", F.lit("。"), "p_type", F.lit("？"), "p_brand")
    line = F.concat(F.when(F.col("p_size") % 2 == 0, "x").otherwise(""), F.lit("第一条 "), "p_brand", F.lit("第二条 "), "p_type")
    return p.select("p_partkey", F.array_join(text.sentences(said), "|").alias("sentences"), F.array_join(text.inline_articles(line), "|").alias("articles"))


@query("""select p_partkey, case p_size % 3 when 0 then p_brand || '办法' when 1 then '关于' || p_type || '的办法' else p_type end as title from part""")
def recovered_titles(spark, sf_dir):
    """Formal titles from the body where the title isn't one."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    title = F.when(size % 3 == 0, F.concat("p_brand", F.lit("办法"))).otherwise(F.col("p_type"))
    body = F.when(size % 3 == 2, "none").otherwise(F.concat(F.lit("x 关于y的办法，关于"), "p_type", F.lit("的办法。")))
    return p.select("p_partkey", text.recover_title(title, body, "关于[^，。]*?的办法", ("办法",)).alias("title"))


@query("""select p_partkey, '| ' || p_brand || ' | ' || replace(p_type, ' ', '\\|') || ' |' || chr(10) || '| --- | --- |' || case when p_size % 2 = 0 then chr(10) || '| ' || p_name || ' |  |' else '' end as markdown from part""".replace("\\\\", "\\"))
def table_markdown(spark, sf_dir):
    """Cells as Markdown tables without empty rows and columns (F8)."""
    p = table(spark, sf_dir, "part")
    cells = F.array(F.array(F.col("p_brand"), F.lit(""), F.replace("p_type", F.lit(" "), F.lit("|"))), F.array(F.lit(""), F.lit(" "), F.lit("")), F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""), F.lit(""), F.lit("")))
    return p.select("p_partkey", text.table_markdown(cells).alias("markdown"))


@query("""select doc_id, source from documents union all select doc_id, source from documents where doc_id < 5""")
def json_round_trip(spark, sf_dir):
    """JSON lines written over, appended to, and read back with a missing file and malformed lines."""
    folder = sinks.work_folder(spark, "json")
    d = _docs(spark, sf_dir).select("source", "doc_id")
    sinks.write_json(d, f"{folder}/a", ["doc_id"])
    sinks.write_json(d.filter("doc_id < 5"), f"{folder}/a", ["doc_id"], mode="append")
    spark.createDataFrame([("not json",), ('{"doc_id": "x"}',), ("",)], "value string").coalesce(1).write.text(f"{folder}/b")
    schema = StructType([StructField("doc_id", LongType()), StructField("source", StringType())])
    return readers.json_lines(spark, [f"{folder}/a", f"{folder}/b", f"{folder}/missing"], schema, strict=False).select("doc_id", "source")


@query("""select doc_id::varchar as doc_id, coalesce(lang, '') as lang, '["' || source || '"]' as sources from documents""")
def csv_round_trip(spark, sf_dir):
    """CSV with a byte order mark, nested columns as JSON, read back (K3)."""
    folder = sinks.work_folder(spark, "csv")
    sinks.write_csv(_docs(spark, sf_dir).select("doc_id", "lang", F.array("source").alias("sources")), folder)
    return sinks.read_csv(spark, folder)


@query("""select source, case when n_chars < 500 then 'rejected' else 'main' end as route, count(*) as n from documents group by all""")
def routed_sink(spark, sf_dir):
    """All routes written at once, a folder each, and read back (K4)."""
    folder = sinks.work_folder(spark, "routed")
    sinks.routed(_docs(spark, sf_dir).select("doc_id", "source", F.when(F.col("n_chars") < 500, "rejected").otherwise("main").alias("route")), "source", "route", folder)
    return spark.read.parquet(folder).groupBy("source", "route").agg(F.count(F.lit(1)).alias("n"))


@query("""select p_partkey || '.md' as file_name, '---' || chr(10) || 'brand: ' || p_brand || case when p_size % 2 = 0 then chr(10) || 'size: ' || p_size else '' end || chr(10) || '---' || chr(10) || chr(10) || p_name as text from part""")
def rendered_files(spark, sf_dir):
    """A front-matter template for each row (K6)."""
    p = table(spark, sf_dir, "part")
    front = sinks.front_matter(brand=F.col("p_brand"), size=F.when(F.col("p_size") % 2 == 0, F.col("p_size")))
    return sinks.rendered(p, F.concat(F.col("p_partkey").cast("string"), F.lit(".md")), front, F.lit(""), F.col("p_name"))


@query("""select distinct user_id, event_type from events""")
def persisted_once(spark, sf_dir):
    """A batch that is run again appends nothing (Q7)."""
    folder = sinks.work_folder(spark, "once")
    rows = table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_type").alias("key"), "user_id", "event_type")
    for part in (rows.filter("user_id % 2 = 0"), rows.filter("user_id % 2 = 0"), rows):
        events.sink_once(folder, "key")(part, 0)
    return spark.read.parquet(folder).select("user_id", "event_type")


@query("""select l_orderkey, l_linenumber, printf('%.2f', l_extendedprice * (1 - l_discount) / 8)::double as eighth, printf('%.1f', l_quantity / 4)::double as quarter, printf('%.0f', l_quantity / 2)::double as half from lineitem""")
def rounded_exactly(spark, sf_dir):
    """Doubles rounded by their binary value, halves to even."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 8
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.round_exact(price, 2).alias("eighth"), text.round_exact(F.col("l_quantity") / 4, 1).alias("quarter"), text.round_exact(F.col("l_quantity") / 2, 0).alias("half"))
