"""Legal texts as column expressions: broken numbers, boundaries, causes of action, keywords, fingerprints, second-pass filters.

Word lists are parameters; where a pattern must be as it is for right results, it is marked as fixed. Null text is empty text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.rules import Rules, cascade, has_any, hits, tags
from corpusloom.functions.text import clean_line, clean_text, let, strip, text_of

# Marks that a broken number may stand before or after.
_AFTER_NUMBER, _BEFORE_NUMBER = "年月日时分秒次条项款届号期％%、〕）)", "年月日〔（(第"
# How an article, a section line and an enumeration sign look, and what a procedural article says.
NUMERAL = "一二三四五六七八九十百千万零〇两0-9"
ARTICLE = "^第[一二三四五六七八九十百零两\\d]+条"
SECTION, ENUMERATION = "^[一二三四五六七八九十]+、.{0,25}$", "^[一二三四五六七八九十]+、"
PROCEDURAL = "本(解释|规定|批复|意见)[^。]{0,40}(施行|实施|不再适用|废止|尚未终审|已经终审)"
# Case types, and laws that the civil code has replaced.
CASE_TYPES = ("民事", "商事", "刑事", "行政", "国家赔偿", "执行")
LEGACY_LAWS = ("合同法", "担保法", "物权法", "民法通则", "民法总则", "婚姻法", "继承法", "收养法", "侵权责任法")


def rejoin_numbers(c: Column) -> Column:
    """A text without line breaks inside numbers, dates and document numbers.

    A break goes by the two characters around it alone, and these stay neighbours of nothing else, so one pass is the fixpoint.
    """
    gap = "[ \\t]*\\n+[ \\t]*"
    return F.regexp_replace(text_of(c), f"(?<=\\d){gap}(?=[\\d{_AFTER_NUMBER}])|(?<=[{_BEFORE_NUMBER}]){gap}(?=\\d)|(?<=〕){gap}(?=[\\d号])", "")


def last_position(c: Column, word: str) -> Column:
    """Where a word stands last in a text, from 1; 0 if it doesn't."""
    back = F.instr(F.reverse(c), word[::-1])
    return F.when(back > 0, F.length(c) - back - len(word) + 2).otherwise(0)


def text_start(c: Column, announcements: Sequence[str], number: str, titles: Sequence[str], title: str, window: int = 1600) -> Column:
    """Where the legal text begins in a page, from 1; null if nothing tells.

    The first announcement of the list that occurs; else, before the document number, the earliest of the titles' last places
    within ``window`` characters, or the window's begin; else the first match of ``title``.
    """
    found = [F.nullif(F.instr(c, a), F.lit(0)) for a in announcements]

    def before(at: Column) -> Column:
        begin = F.greatest(F.lit(1), at - window)
        return let(F.substring(c, begin, at - begin), lambda w: F.coalesce(F.least(*(F.nullif(last_position(w, t), F.lit(0)) for t in titles), F.lit(None).cast("int")) + begin - 1, begin))

    # a pattern that isn't there is at place 0
    by_number = let(F.regexp_instr(c, F.lit(number)), lambda at: F.when(at > 0, before(at)))
    return F.coalesce(*found, by_number, F.nullif(F.regexp_instr(c, F.lit(title)), F.lit(0)))


def split_legal_text(c: Column, *how, **more) -> Column:
    """Struct of the explanation before a legal text and the text itself; no explanation where no start is found."""
    def parts(t: Column) -> Column:
        return let(F.coalesce(text_start(t, *how, **more), F.lit(1)), lambda at: F.struct(strip(F.left(t, at - 1)).alias("explanation"), strip(F.substring(t, at, F.length(t))).alias("legal_text")))

    return let(clean_text(c), parts)


def legacy_laws(c: Column, laws: Sequence[str] = LEGACY_LAWS) -> Column:
    """Superseded laws that a text names, in the list's order."""
    return hits(c, laws)


def title_subject(c: Column) -> Column:
    """A case's title without the number before its colon; the whole title if nothing would be left."""
    t = clean_line(c)
    bare = strip(F.regexp_replace(t, "^.*?(?:案例|入库编号|案号)[^：:]*[：:]", ""))
    return F.when(bare == "", t).otherwise(bare)


# How names of organisations and people end, and how causes begin that aren't names.
PARTY_ENDS = (
    "股份有限公司 有限责任公司 有限公司 分公司 子公司 公司 信用合作社 信用社 合作社 联社 银行 事务所 研究所 设计院 医院 学校 学院 大学 管理委员会 村民委员会 居民委员会 "
    "委员会 管委会 政府 管理局 分局 支局 邮局 税务局 集团 协会 学会 基金会 商会 工厂 商行 商店 超市 宾馆 酒店 中心"
).split()
PERSON = "[一-龥]{1,3}某(?:某|[甲乙丙丁戊]|[一-龥])?"
CAUSE_VERBS = ("损害", "侵害", "侵犯", "妨害", "请求", "确认", "返还", "排除", "撤销", "追偿", "追索")
RESIDUE = "某|、|，|等|公司|银行|学校|学院|医院|中心|甲|乙|丙|丁|戊"


def cause_of_action(title: Column, heads: Sequence[str] = ()) -> Column:
    """The cause in a case's title: without number, plaintiff, and the defendants in front of it.

    Defendants are taken off one after another by one repeated pattern whose names are atomic, each the shortest that ends like an
    organisation or a person and isn't the end of the text. Of known causes (``heads``), the longest that has only the rest of a
    name before it begins the result.
    """
    name = "(?>[一-龥A-Za-z0-9()（）·.\\-　 ]{1,40}?(?:" + "|".join(PARTY_ENDS) + f"|{PERSON}))"
    parties = f"^(?:(?!{'|'.join(CAUSE_VERBS)}){name}(?=.)(?>[、，及和与等]*))+"
    t = F.regexp_replace(title_subject(title), "\\s*案$", "")
    t = let(t, lambda x: F.when(F.contains(x, F.lit("诉")), F.regexp_replace(x, "^[^诉]*诉", "")).otherwise(F.regexp_replace(x, "^[^与]*与", "")))
    t = F.regexp_replace(t, parties, "")
    t = F.regexp_replace(strip(F.regexp_replace(t, "^[一-龥]{2,4}等(?=[、，]?[一-龥])", "")), "^(?:等人|等|因|及|、|，|和)+", "")
    known = sorted(set(heads), key=lambda h: (-len(h), h))

    def trimmed(x: Column) -> Column:
        if not known:
            return x
        places = F.transform(F.array(*map(F.lit, known)), lambda h: F.position(h, x))
        fit = F.filter(places, lambda at: (at > 1) & (at <= 25) & ((at <= 3) | F.left(x, at - 1).rlike(RESIDUE)))
        return F.when(F.size(fit) > 0, F.substring(x, F.get(fit, F.lit(0)), F.length(x))).otherwise(x)

    return clean_line(let(strip(t), trimmed))


def case_type(keywords: Column) -> Column:
    """The case type that keywords begin with, empty for anything else."""
    first = F.get(F.split(strip(keywords), "[/／、,，\\s]", 2), F.lit(0))
    return F.when(first.isin(*CASE_TYPES), first).otherwise("")


def keywords_line(keywords: Column) -> Column:
    """Keywords without the case type in front, joined by middle dots."""
    parts = F.filter(F.split(clean_line(keywords), "[/／、]"), lambda x: x != "")
    return F.array_join(let(parts, lambda p: F.when(F.get(p, F.lit(0)).isin(*CASE_TYPES), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p)), "·")


def dispute_focus(reasoning: Column) -> Column:
    """The sentence after 争议焦点为 and the like, empty if there is none."""
    return F.regexp_replace(F.regexp_extract(text_of(reasoning), "(?:本案的?)?(?:争议)?焦点[为是：:]\\s*([^。\\n]{6,120}。?)", 1), "^[ ：:，,为是]+|[ ：:，,为是]+$", "")


def article_range(c: Column) -> Column:
    """First and last article of a text, else first and last decimal number that begins a line; one if they are the same."""
    ends = lambda a: F.array_distinct(F.filter(F.array(F.get(a, F.lit(0)), F.try_element_at(a, F.lit(-1))), lambda x: x.isNotNull()))
    articles = F.regexp_extract_all(text_of(c), F.lit(f"第[{NUMERAL}]+条"), F.lit(0))
    numbers = F.regexp_extract_all(text_of(c), F.lit("(?m)^(\\d+(?:\\.\\d+)+)"), F.lit(1))
    return let(ends(articles), lambda a: F.when(F.size(a) > 0, a).otherwise(ends(numbers)))


def fingerprint(c: Column, taxonomies: Mapping[str, tuple[Rules, int]], clause_types: Column | None = None, extended: str | None = None) -> Column:
    """Struct of a clause's labels in each taxonomy {name: (rules, most labels)}.

    ``extended`` names the taxonomy that known clause types add to: the labels with a keyword that contains, or is in, one of them.
    """
    def labels(t: Column) -> Column:
        fields = []
        for name, (rules, most) in taxonomies.items():
            found = F.slice(tags(t, rules), 1, most)
            if clause_types is not None and name == extended:
                kinds = F.filter(clause_types, lambda k: text_of(k) != "")
                pairs = F.array(*(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("words")) for label, words in rules.items()))
                akin = lambda k: F.transform(F.filter(pairs, lambda p: F.exists(p["words"], lambda w: F.contains(w, k) | F.contains(k, w))), lambda p: p["label"])  # noqa: E731, B023
                found = F.array_distinct(F.concat(found, F.flatten(F.transform(kinds, akin))))
            fields.append(found.alias(name))
        return F.struct(*fields)

    return let(clean_text(c), labels)


def short_name(title: Column) -> Column:
    """An interpretation's short name: its title without the words that frame the subject; the title if nothing is left."""
    t = F.regexp_replace(text_of(title), "^最高人民法院|中华人民共和国|[《》〈〉]", "")
    t = F.regexp_replace(F.regexp_replace(t, "(具体应用法律|适用法律)(若干)?问题的", ""), "(若干)?问题的|(纠纷)?案件", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^关于(审理|适用|执行)?", ""), "有关", ""), "^[ 、的]+|[ 、的]+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.nullif(title, F.lit("")), F.lit("未命名"))


def playbook_second_pass(priority: Column, title: Column, context: Column, body: Column, direct: Sequence[str], broad: Sequence[str], topics: Sequence[str], noise: Sequence[str], litigation: Sequence[str], least: int = 800, head: int = 5000) -> Column:
    """Struct of priority (the decision), keep, reason and matched words for a guide that passed the first filter.

    context: title, category and committee together. Review is the default; only a direct contract subject is included.
    """
    named = has_any(title, ("合同", "协议"))
    straight = F.concat(F.when(named, F.array(F.lit("合同/协议"))).otherwise(F.array().cast("array<string>")), hits(context, direct))
    front = F.left(text_of(body), F.lit(head))
    return cascade(
        [
            (has_any(title, noise), False, "review_drop", "event or notice", hits(title, noise)),
            (F.length(text_of(body)) < least, False, "review", "short text", None),
            (clean_line(priority) != "P0_CONTRACT", False, "review", "adjacent subject", None),
            (has_any(title, topics), False, "review", "broad or compliance subject", hits(title, topics)),
            ((F.size(straight) > 0) & has_any(title, litigation) & ~has_any(title, ("合同", "协议", "建设工程", "股权", "劳动")), False, "review", "litigation", hits(title, litigation)),
            (F.size(straight) > 0, True, "include_main", "contract subject", straight),
            (F.contains(front, F.lit("合同")) & has_any(front, ("审查", "起草")), False, "review", "contract chapter in a broad text", None),
            (has_any(context, broad), False, "review", "broad adjacent subject", hits(context, broad)),
        ],
        ("review", "no direct subject"),
    )


def template_second_pass(priority: Column, title: Column, body: Column, notices: Sequence[str], forms: Sequence[str], parties: Sequence[str], head: int = 800) -> Column:
    """Struct of keep, priority, reason and matched words for a contract template that passed the first filter."""
    front = F.left(text_of(body), F.lit(head))
    return cascade(
        [
            (has_any(title, notices), False, "review", "notice or guide", hits(title, notices)),
            (text_of(priority) == "P0_STANDARD", True, "main", "model text", None),
            (has_any(title, forms), True, "main", "form in title", hits(title, forms)),
            (has_any(front, parties), True, "main", "form in text", hits(front, parties)),
        ],
        ("review", "no form"),
    )


def heading_one(c: Column) -> Column:
    """The first heading of level one of a Markdown text, empty if there is none."""
    return strip(F.regexp_extract(text_of(c), "(?m)^#[ \\t]+(\\S[^\\n]*)$", 1))


def stamped(c: Column, key: str, value: Column) -> Column:
    """A Markdown text whose line ``- key: ...`` says ``value``; the line is put after the first heading if there is none."""
    line = F.concat(F.lit(f"- {key}: "), value)
    there = f"(?m)^- {key}:[^\\n]*$"
    safe = F.regexp_replace(line, "([\\\\$])", "\\\\$1")
    return F.when(text_of(c).rlike(there), F.regexp_replace(text_of(c), F.lit(there), safe)).otherwise(F.regexp_replace(text_of(c), F.lit("(?m)\\A(#[ \\t]+[^\\n]*\\n)?"), F.concat(F.lit("$1"), safe, F.lit("\n"))))


def risk_tips(html: Column, item: str = "samr-view-risk-item") -> Column:
    """Array of (title, content) of the risk tips of a page: elements of class ``item`` with parts of class title and content.

    Tips stand side by side, so a tip is what follows its opening tag up to the next one's; markup inside is taken off.
    """
    plain = lambda x: clean_line(F.regexp_replace(x, "<[^>]*>", " "))
    blocks = F.slice(F.split(text_of(html), f"<[a-zA-Z]+\\b[^>]*class\\s*=\\s*[\"'][^\"']*\\b{item}\\b[^\"']*[\"'][^>]*>"), F.lit(2), F.lit(1 << 30))
    part = lambda b, name: F.regexp_extract(b, f"(?s)<([a-zA-Z]+)\\b[^>]*class\\s*=\\s*[\"'][^\"']*\\b{name}\\b[^\"']*[\"'][^>]*>(.*?)</\\1>", 2)
    tips = F.transform(blocks, lambda b: F.struct(F.regexp_replace(plain(part(b, "title")), " ", "").alias("title"), plain(part(b, "content")).alias("content")))
    return F.filter(tips, lambda t: (t["title"] != "") | (t["content"] != ""))


def tips_text(tips: Column) -> Column:
    """Risk tips as Markdown, numbered from 1."""
    said = F.transform(tips, lambda t, n: F.concat_ws("\n\n", F.concat(F.lit("**"), (n + 1).cast("string"), F.lit("."), F.when(t["title"] != "", F.concat(F.lit(" "), t["title"])).otherwise(""), F.lit("**")), F.nullif(t["content"], F.lit(""))))
    return F.array_join(said, "\n\n")
