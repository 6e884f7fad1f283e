"""Rule classifiers over documents. The dictionaries are small ones in the languages of the tables; the operators take any."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.operators import aggregates
from corpusloom.plans.registry import query
from corpusloom.sources.readers import table

TOPICS = {"english": ("the ", " and "), "french": ("que ", " des "), "german": ("der ", " und "), "licence": ("Licensed", "License")}
DUTIES = ("the", "que", "der", "los", "with")
DIMENSIONS = {"money": ("$", "€"), "table": ("|",), "mail": ("@",), "licence": ("License",)}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars", "lang")


def _any(column, words):
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _tags(column):
    return "concat_ws(',', " + ", ".join(f"case when {_any(column, words)} then '{label}' end" for label, words in TOPICS.items()) + ")"


@query(f"select doc_id, coalesce(nullif({_tags('text')}, ''), 'general') as tags from documents")
def tag_multilabel(spark, sf_dir):
    """All labels with a keyword in the text."""
    return _docs(spark, sf_dir).select("doc_id", F.array_join(rules.tags(F.col("text"), TOPICS, ("general",)), ",").alias("tags"))


@query("select doc_id, case " + " ".join(f"when {_any('text', w)} then '{k}'" for k, w in TOPICS.items()) + " else 'other' end as rule from documents")
def classify_first_match(spark, sf_dir):
    """The first rule that hits (P5)."""
    return _docs(spark, sf_dir).select("doc_id", rules.first_rule(F.col("text"), TOPICS, "other").alias("rule"))


_SCORES = ", ".join(f"({' + '.join(f'contains(text, chr(32) || {chr(39)}{w.strip()}{chr(39)})::int' for w in words)}) as s{n}" for n, words in enumerate((("the", "of"), ("le", "que"), ("der", "und"))))


@query(f"""with s as (select doc_id, {_SCORES} from documents)
select doc_id, case when greatest(s0, s1, s2) = 0 then 'none' when s0 >= s1 and s0 >= s2 then 'en' when s1 >= s2 then 'fr' else 'de' end as stage from s""")
def argmax_stage(spark, sf_dir):
    """The label with the most keywords, the first of equals."""
    stages = {"en": (" the", " of"), "fr": (" le", " que"), "de": (" der", " und")}
    return _docs(spark, sf_dir).select("doc_id", rules.best_rule(F.col("text"), stages, "none").alias("stage"))


_CASCADE = """select doc_id, text as t from documents"""


@query(f"""with d as ({_CASCADE}), c as (select doc_id, contains(t, '|') as bad, contains(t, 'tion') as p0, contains(t, 'der ') as p1, regexp_matches(t, '[.]') as real from d)
select doc_id, real and not bad and (p0 or p1) as keep, case when not real then 'DROP_NONINSTRUMENT' when bad then 'DROP' when p0 then 'P0_CONTRACT' when p1 then 'P1_CIVIL' else 'DROP' end as priority,
  case when not real then 'not an instrument' when bad then 'excluded: |' when p0 then 'contract: tion' when p1 then 'civil: der ' else 'no signal' end as reason from c""")
def classify_cascade(spark, sf_dir):
    """Relevance by a cascade that gives keep, priority and reason (P7); the text stands in for a title, as in the cascades below."""
    decided = rules.instrument_relevance(F.col("text"), F.lit(""), "[.]", (), ("|",), ("tion",), ("der ",), ("\x01",))
    return _docs(spark, sf_dir).select("doc_id", decided.alias("d")).select("doc_id", "d.keep", "d.priority", "d.reason")


@query("""with c as (select doc_id, text as t, source, regexp_extract_all(text, '第([0-9]{1,4})条', 1) as nums from documents)
select doc_id, case when t = '' then 'DROP_NONCASE' when contains(source || chr(10) || t, '%%%') then 'DROP' when contains(t, '合同') or contains(t, '协议') then 'P0_CONTRACT' when source = 'src3' then 'DROP'
  when source = 'src5' then 'P1_CAUSE' when contains(t, 'License') then 'P1_STATUTE' when contains(t, 'ment') then 'P2_KEYWORD' else 'DROP' end as priority from c""")
def classify_cases(spark, sf_dir):
    """Case relevance by title, cause, statute and keyword."""
    d = rules.case_relevance(F.col("text"), F.col("source"), F.concat(F.col("source"), F.lit(".")), F.col("text"), F.col("text"), ("%%%",), ("src3.",), ("src5.",), "License", ("ment",))
    return _docs(spark, sf_dir).select("doc_id", d["priority"].alias("priority"))


@query("""select doc_id, case when contains(text, '%%%') then 'DROP_NEWS' when contains(text, '|') and not contains(text, 'License') then 'DROP' when contains(text, 'License') then 'P0'
  when contains(text, 'ing ') or source = 'src1' then 'P1' when doc_id % 10 = 0 then 'SEED' else 'DROP' end as priority,
  doc_id % 10 = 0 or (not contains(text, '%%%') and (contains(text, 'License') or (not contains(text, '|') and (contains(text, 'ing ') or source = 'src1')))) as keep from documents""")
def classify_guides(spark, sf_dir):
    """Guide relevance; pinned seeds are always kept."""
    d = rules.guide_relevance(F.col("text"), F.concat(F.col("source"), F.lit(".")), ("%%%",), ("|",), ("License",), ("ing ",), ("src1.",), F.col("doc_id") % 10 == 0)
    return _docs(spark, sf_dir).select("doc_id", d["priority"].alias("priority"), d["keep"].alias("keep"))


@query("""select doc_id, case when contains(text, '###') then 'DROP_POLICY' when doc_id % 9 = 0 then 'P0' when contains(text, 'tion') then 'P1' else 'DROP' end as priority from documents""")
def classify_templates(spark, sf_dir):
    """Template relevance (P10)."""
    d = rules.template_relevance(F.col("text"), F.when(F.col("doc_id") % 9 == 0, "n").otherwise(""), F.lit(None).cast("string"), ("###",), ("tion",))
    return _docs(spark, sf_dir).select("doc_id", d["priority"].alias("priority"))


@query(f"""with r as (select source, case when n_chars < 200 then 'rejected' when {_any('text', ('|', '%%%'))} then 'review' else 'main' end as route from documents) select source, route, count(*) as n from r group by source, route""")
def route_counts(spark, sf_dir):
    """Rows of each source by route."""
    route = F.when(F.col("n_chars") < 200, "rejected").when(rules.has_any(F.col("text"), ("|", "%%%")), "review").otherwise("main")
    return aggregates.histogram(_docs(spark, sf_dir).withColumn("route", route), "source", "route")


_TIGHT = r"regexp_replace(text, '[\s\x0B]+', '', 'g')"
_DIMS = " + ".join(_any("text", w) + "::int" for w in DIMENSIONS.values())


# every kind of clause candidate, made of a document: as it is, its letters as blanks, its lines as table rows, with signature marks, as a definition, without what tells of a dimension
_KINDS = {
    1: """regexp_replace(text, '[a-z]', '□', 'g')""",
    2: """'|' || replace(text, chr(10), '|' || chr(10) || '|') || '|'""",
    3: """'甲方签字 乙方盖章 日期 ' || text""",
    4: """'所称货物是指 ' || replace(replace(translate(text, '$€|@', ''), 'License', ''), 'the', '')""",
    5: """'包括类别 ' || replace(translate(text, '$€|@', ''), 'License', '')""",
}
# and short candidates: the sources of all documents, under ids of their own
_CANDIDATES = "select doc_id, text from documents union all select -1 - doc_id, source from documents"


@query("with k as (select doc_id, case when doc_id < 0 then text else case doc_id % 7 " + " ".join(f"when {k} then {sql}" for k, sql in _KINDS.items()) + f""" else text end end as text from ({_CANDIDATES})),
c as (select doc_id, text, {_TIGHT} as tight, {_DIMS} as dims, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) as l from k), s as (
  select *, 3 * dims + {' + '.join(f"contains(tight, '{w}')::int" for w in DUTIES)} + case when length(tight) >= 180 then 2 when length(tight) >= 100 then 1 else 0 end as score,
    case when length(tight) = 0 then 1.0 else least(1.0, 2.0 * (length(tight) - length(replace(tight, '□', ''))) / length(tight)) end as blank,
    case when len(l) = 0 then 0.0 else len(list_filter(l, lambda x: regexp_matches(x, '^\\s*\\|(.*\\|)?\\s*$')))::double / len(l) end as in_table from c)
select doc_id, score, concat_ws(',', case when length(tight) < 40 or (length(tight) < 80 and dims = 0) then 'too_short' end, case when blank > 0.35 then 'too_many_placeholders' end, case when in_table >= 0.75 then 'table_only' end,
  case when contains(tight, '签字')::int + contains(tight, '盖章')::int + contains(tight, '日期')::int + contains(tight, '附件')::int >= 3 then 'signature_or_meta' end,
  case when dims = 0 and ((doc_id % 7 = 5 and contains(tight, '包括')) or (contains(tight, '是指') and not ({' or '.join(f"contains(tight, '{w}')" for w in DUTIES)}))) then 'pure_definition_or_category' end,
  case when dims = 0 and score < 2 then 'no_meaningful_risk_dimension' end) as reasons from s""")
def rule_filter_reasons(spark, sf_dir):
    """Score and all six reasons of clause candidates of every kind."""
    plain = F.translate("text", "$€|@", "")
    kinds = {
        1: F.regexp_replace("text", "[a-z]", "□"),
        2: F.concat(F.lit("|"), F.replace("text", F.lit("\n"), F.lit("|\n|")), F.lit("|")),
        3: F.concat(F.lit("甲方签字 乙方盖章 日期 "), "text"),
        4: F.concat(F.lit("所称货物是指 "), F.replace(F.replace(plain, F.lit("License"), F.lit("")), F.lit("the"), F.lit(""))),
        5: F.concat(F.lit("包括类别 "), F.replace(plain, F.lit("License"), F.lit(""))),
    }
    text = F.col("text")
    for k, made in kinds.items():
        text = F.when((F.col("doc_id") >= 0) & (F.col("doc_id") % 7 == k), made).otherwise(text)
    title = F.when(F.col("doc_id") % 7 == 5, "释义").otherwise("正文")
    judged = rules.let(text, lambda t: rules.clause_judgement(title, t, DIMENSIONS, DUTIES, ("签字", "盖章", "日期", "附件"), ("释义",), "□", "□"))
    docs = _docs(spark, sf_dir)
    candidates = docs.select("doc_id", "text").unionAll(docs.select(-1 - F.col("doc_id"), "source"))
    return candidates.select("doc_id", rules.let(judged, lambda j: F.struct(j["score"].alias("score"), F.array_join(j["reasons"], ",").alias("reasons"))).alias("j")).select("doc_id", "j.*")


@query(r"""with m as (select doc_id, regexp_replace(text, '\s+', '', 'g') as tight, list_sum(list_transform(regexp_extract_all(text, '[|%]{2,}|[*]'), lambda x: length(x))) as n from documents)
select doc_id, round(case when length(tight) = 0 then 1.0 else least(1.0, (coalesce(n, 0) + length(tight) - length(regexp_replace(tight, '[|]', '', 'g')))::double / length(tight)) end, 6) as share from m""")
def placeholder_ratio(spark, sf_dir):
    """Share of placeholder characters, some counted twice."""
    return _docs(spark, sf_dir).select("doc_id", F.round(rules.placeholder_share(F.col("text"), "[|%]{2,}|[*]", "[|]"), 6).alias("share"))


@query("""select doc_id, round(greatest(0.1, 1.0 + case when n_chars < 500 then -0.3 else 0 end + case when contains(text, 'License') then -0.8 else 0 end), 2) as weight,
  case when contains(text, '已废止') then 'superseded' else 'active' end as status from documents""")
def weights_and_status(spark, sf_dir):
    """Retrieval weights and status flags."""
    w = rules.weight(F.lit(1.0), (F.col("n_chars") < 500, -0.3), (F.contains(F.col("text"), F.lit("License")), -0.8))
    return _docs(spark, sf_dir).select("doc_id", w.alias("weight"), rules.status(F.col("text")).alias("status"))


@query("""select doc_id, case when n_chars > 3000 and contains(text, 'ing ') and contains(text, 'tion') then 'full' when lang = 'en' and contains(text, 'ing ') then 'holding_reasoning' when lang = 'en' then 'holding'
  when contains(text, 'ing ') or n_chars > 3000 then 'partial' else 'title_only' end as depth from documents""")
def content_depth(spark, sf_dir):
    """How much of a case is there."""
    part = lambda c: F.when(c, "x").otherwise("")
    has = lambda w: F.contains(F.col("text"), F.lit(w))
    return _docs(spark, sf_dir).select("doc_id", rules.depth(part(F.col("n_chars") > 3000), part(has("ing ")), part(has("tion")), part(F.col("lang") == "en")).alias("depth"))


@query("""select lang, case lang when 'en' then 'both' when 'fr' then 'third' else 'unknown' end as party, count(*) as n from documents group by lang""")
def coerced_enums(spark, sf_dir):
    """Values through a synonym table (P20)."""
    return _docs(spark, sf_dir).groupBy("lang", rules.coerce(F.col("lang"), {"en": "both", "fr": "third"}, "unknown").alias("party")).agg(F.count(F.lit(1)).alias("n"))


@query("""select event_id, case when event_type in ('click', 'view') then event_type else '其他' end as category from events""")
def category_map(spark, sf_dir):
    """Categories from a model's reply, known ids and values only."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('ok: {"a": "'), F.col("event_type"), F.lit('", "zz": "view"} done')).alias("reply"))
    found = rules.category_map(F.col("reply"), F.array(F.lit("a"), F.lit("b")), ("click", "view"))
    return e.select("event_id", found["a"].alias("category"))


@query("""select doc_id, case when lang = 'en' and contains(text, 'License') then 'english,licence' when lang = 'en' then 'english' when contains(text, 'License') then 'x,licence' else 'x' end as domains from documents""")
def merged_domains(spark, sf_dir):
    """Raw domains through aliases with inferred ones, each once."""
    raw = F.when(F.col("lang") == "en", "en/en").otherwise("x 通用")
    inferred = F.when(F.contains(F.col("text"), F.lit("License")), F.array(F.lit("licence"))).otherwise(F.array().cast("array<string>"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(rules.merge_domains(raw, inferred, {"en": "english"}), ",").alias("domains"))


@query("""select doc_id, case when doc_id % 2 = 0 then case when contains(text, 'tion') then 'service,other' else 'other' end when contains(source, 'tion') or contains(text, 'tion') then 'service' else '' end as kept from documents""")
def pruned_tags(spark, sf_dir):
    """A tag that stays only with proof (E14): of two tags in the text as title, of a lone one (odd ids) in the source or the text as body."""
    lone = F.col("doc_id") % 2 != 0
    tags = F.when(lone, F.array(F.lit("service"))).otherwise(F.array(F.lit("service"), F.lit("other")))
    title = F.when(lone, F.col("source")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(rules.prune_tag(tags, "service", title, F.col("text"), "tion"), ",").alias("kept"))
