"""Rule dictionaries as column expressions: taggers, first-match and arg-max classifiers, cascades, gates and weights.

Dictionaries are ordered ``{label: keywords}`` mappings given by the caller, and become one literal in the plan, so a classifier is a
narrow projection that Catalyst keeps inside the scan's stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import compact, let, text_of

Rules = Mapping[str, Sequence[str]]


def has_any(c: Column, keywords: Sequence[str]) -> Column:
    """Whether a text contains one of the keywords."""
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(text_of(c), F.lit(k))
    return out


def hits(c: Column, keywords: Sequence[str]) -> Column:
    """The keywords that a text contains, in the dictionary's order."""
    return F.filter(F.array(*map(F.lit, keywords)).cast("array<string>"), lambda k: F.contains(text_of(c), k))


def count_hits(c: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords a text contains."""
    out = F.lit(0)
    for k in keywords:
        out = out + F.contains(text_of(c), F.lit(k)).cast("int")
    return out


def tags(c: Column, rules: Rules, default: Sequence[str] = ()) -> Column:
    """All labels with a keyword in the text, in the dictionary's order, or ``default``."""
    found = F.array_compact(F.array(*(F.when(has_any(c, words), F.lit(label)) for label, words in rules.items())))
    return F.when(F.size(found) == 0, F.array(*map(F.lit, default)).cast("array<string>")).otherwise(found)


def domain_tags(title: Column, body: Column, rules: Rules, default: Sequence[str] = ("通用",), head: int = 2000) -> Column:
    """Tags of the title with the front of the body."""
    return tags(F.concat(text_of(title), F.lit("\n"), F.left(text_of(body), F.lit(head))), rules, default)


def first_rule(c: Column, rules: Rules, default: str) -> Column:
    """The first label with a keyword in the text."""
    out = None
    for label, words in rules.items():
        out = F.when(has_any(c, words), label) if out is None else out.when(has_any(c, words), label)
    return F.lit(default) if out is None else out.otherwise(default)


def best_rule(c: Column, rules: Rules, default: str, lead: Rules | None = None, head: int = 300) -> Column:
    """The label with the most distinct keywords in the text, the first of equals; a ``lead`` keyword in the text's front overrides."""
    scored = [F.struct(count_hits(c, words).alias("score"), F.lit(-pos).alias("pos"), F.lit(label).alias("label")) for pos, (label, words) in enumerate(rules.items())]
    best = F.array_max(F.array(*scored))
    out = F.when(best["score"] > 0, best["label"]).otherwise(default)
    for label, words in reversed(list((lead or {}).items())):
        out = F.when(has_any(F.left(text_of(c), F.lit(head)), words), label).otherwise(out)
    return out


def cascade(steps: Sequence[tuple[Column, bool, str, Column | str, Column | None]], default: tuple[str, str]) -> Column:
    """A relevance decision: the first step whose condition holds gives keep, priority, reason and matched keywords.

    steps: (condition, keep, priority, reason, matched). default: priority and reason when none holds.
    """
    none = F.array().cast("array<string>")
    reason = lambda r: r if isinstance(r, Column) else F.lit(r)
    decision = lambda keep, priority, why, matched: F.struct(F.lit(keep).alias("keep"), F.lit(priority).alias("priority"), reason(why).alias("reason"), matched.alias("matched"))
    out = None
    for condition, keep, priority, why, matched in steps:
        value = decision(keep, priority, why, none if matched is None else matched)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    last = decision(False, *default, none)
    return last if out is None else out.otherwise(last)


def instrument_relevance(titles: Column, number: Column, form: str, suffixes: Sequence[str], excluded: Sequence[str], primary: Sequence[str], secondary: Sequence[str], sure: Sequence[str] = ("合同", "协议")) -> Column:
    """Cascade for legal instruments by their titles alone: no instrument, excluded, primary, secondary, none."""
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | titles.rlike(f"(?m){s}$")
    real = (text_of(number) != "") | titles.rlike(form) | ends
    bad, good, civil = hits(titles, excluded), hits(titles, primary), hits(titles, secondary)
    named = has_any(titles, sure)
    good = F.concat(F.when(named, F.array(F.lit("/".join(sure)))).otherwise(F.array().cast("array<string>")), good)
    why = lambda text, found: F.concat(F.lit(text), F.array_join(found, "、"))
    return cascade(
        [
            (~real, False, "DROP_NONINSTRUMENT", "not an instrument", None),
            (F.size(bad) > 0, False, "DROP", why("excluded: ", bad), bad),
            (F.size(good) > 0, True, "P0_CONTRACT", why("contract: ", good), good),
            (F.size(civil) > 0, True, "P1_CIVIL", why("civil: ", civil), civil),
        ],
        ("DROP", "no signal"),
    )


def case_relevance(title: Column, kind: Column, cause: Column, statutes: Column, keywords: Column, excluded: Sequence[str], other_causes: Sequence[str], extra_causes: Sequence[str], laws: str, signals: Sequence[str]) -> Column:
    """Cascade for cases: not a case, criminal or administrative, contract in title, other cause, extra cause, statute, keyword, none."""
    numbers = F.transform(F.regexp_extract_all(text_of(statutes), F.lit(r"第(\d{1,4})条"), F.lit(1)), lambda x: F.try_to_number(x, F.lit("9999")).cast("int"))
    cited = text_of(statutes).rlike(laws) | F.exists(numbers, lambda n: n.between(463, 988))
    found = hits(keywords, signals)
    return cascade(
        [
            (text_of(title) == "", False, "DROP_NONCASE", "no title", None),
            (has_any(F.concat_ws("\n", kind, title), excluded), False, "DROP", "other branch of law", None),
            (has_any(title, ("合同", "协议")), True, "P0_CONTRACT", "title", None),
            (has_any(cause, other_causes), False, "DROP", "cause", None),
            (has_any(cause, extra_causes), True, "P1_CAUSE", "cause", hits(cause, extra_causes)),
            (cited, True, "P1_STATUTE", "statute", None),
            (F.size(found) > 0, True, "P2_KEYWORD", "keyword", found),
        ],
        ("DROP", "no signal"),
    )


def guide_relevance(title: Column, committee: Column, news: Sequence[str], excluded: Sequence[str], primary: Sequence[str], secondary: Sequence[str], committees: Sequence[str], seeded: Column) -> Column:
    """Cascade for practice guides; pinned seeds are always kept."""
    p0, p1 = hits(title, primary), hits(title, secondary)
    decision = cascade(
        [
            (has_any(title, news), False, "DROP_NEWS", "news", None),
            (has_any(title, excluded) & (F.size(p0) == 0), False, "DROP", "excluded", hits(title, excluded)),
            (F.size(p0) > 0, True, "P0", "primary", p0),
            ((F.size(p1) > 0) | has_any(committee, committees), True, "P1", "secondary", p1),
            (seeded, True, "SEED", "seed", None),
        ],
        ("DROP", "no signal"),
    )
    return decision.withField("keep", decision["keep"] | F.coalesce(seeded, F.lit(False)))


def template_relevance(title: Column, number: Column, keywords: Column, policy: Sequence[str], words: Sequence[str]) -> Column:
    """Cascade for contract templates: policy papers go, numbered or model texts stay, else keywords decide."""
    text = F.concat_ws("\n", title, keywords)
    return cascade(
        [
            (has_any(title, policy), False, "DROP_POLICY", "policy", None),
            ((text_of(number) != "") | has_any(title, ("示范文本",)), True, "P0", "model text", None),
            (has_any(text, words), True, "P1", "keyword", hits(text, words)),
        ],
        ("DROP", "no signal"),
    )


# What counts as a placeholder, and what of it counts a second time.
PLACEHOLDERS, COUNTED_AGAIN = r"[_＿]{2,}|□|（\s*）|\(\s*\)|年\s*月\s*日", "[_＿□]"


def placeholder_share(c: Column, pattern: str = PLACEHOLDERS, again: str = COUNTED_AGAIN, tight: Column | None = None) -> Column:
    """Share of placeholder characters: what ``pattern`` matches plus, counted again, blanks and boxes; at most 1, and 1 for no text.

    tight: the text without white space, where it is known already.
    """
    matched = F.length(compact(F.array_join(F.regexp_extract_all(text_of(c), F.lit(pattern), F.lit(0)), "")))
    share = lambda t: let(F.length(t), lambda n: F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), (matched + n - F.length(F.regexp_replace(t, again, ""))) / F.greatest(n, F.lit(1)))))
    return let(compact(c), share) if tight is None else share(tight)


def table_share(c: Column) -> Column:
    """Share of a text's lines that are table rows; 0 without lines."""
    return let(F.filter(F.split(text_of(c), "\n"), lambda x: x.rlike(r"(?U)\S")), lambda rows: let(F.size(rows), lambda n: F.when(n == 0, 0.0).otherwise(F.size(F.filter(rows, lambda x: x.rlike(r"(?U)^\s*\|(.*\|)?\s*$"))) / F.greatest(n, F.lit(1)))))


def clause_score(c: Column, dimensions: Rules, duties: Sequence[str]) -> Column:
    """3 for each dimension, 1 for each duty word, 2 or 1 for length."""
    return let(compact(c), lambda tight: _score(tight, F.size(tags(c, dimensions)), duties))


def _score(tight: Column, n_dimensions: Column, duties: Sequence[str]) -> Column:
    size = F.length(tight)
    return 3 * n_dimensions + count_hits(tight, duties) + F.when(size >= 180, 2).when(size >= 100, 1).otherwise(0)


def clause_judgement(title: Column, c: Column, dimensions: Rules, duties: Sequence[str], signatures: Sequence[str], info_titles: Sequence[str], placeholders: str = PLACEHOLDERS, again: str = COUNTED_AGAIN) -> Column:
    """Struct of a clause's score and reasons: why it is no candidate, an empty array if it is one."""

    def judged(known: Column) -> Column:
        tight, size, bare, score = known["tight"], F.length(known["tight"]), known["dims"] == 0, known["score"]
        info = has_any(title, info_titles) & has_any(tight, ("包括", "分为", "是指")) & bare
        listing = F.contains(tight, F.lit("包括")) & has_any(tight, ("两大类", "类别")) & bare
        meaning = has_any(tight, ("是指", "以下简称")) & bare & (count_hits(tight, duties) == 0)
        tests = (
            ("too_short", (size < 40) | ((size < 80) & bare)),
            ("too_many_placeholders", placeholder_share(c, placeholders, again, tight) > 0.35),
            ("table_only", table_share(c) >= 0.75),
            ("signature_or_meta", count_hits(tight, signatures) >= 3),
            ("pure_definition_or_category", info | listing | meaning),
            ("no_meaningful_risk_dimension", bare & (score < 2)),
        )
        return F.struct(score.alias("score"), F.array_compact(F.array(*(F.when(test, F.lit(reason)) for reason, test in tests))).alias("reasons"))

    # the tight text, its dimensions and its score are each worked out once
    text = lambda tight, dims: let(F.struct(tight.alias("tight"), dims.alias("dims"), _score(tight, dims, duties).alias("score")), judged)
    return let(F.struct(compact(c).alias("tight"), F.size(tags(c, dimensions)).alias("dims")), lambda k: text(k["tight"], k["dims"]))


def clause_reasons(title: Column, c: Column, dimensions: Rules, duties: Sequence[str], signatures: Sequence[str], info_titles: Sequence[str]) -> Column:
    """Why a clause is no candidate: an array of reasons, empty if it is one."""
    return clause_judgement(title, c, dimensions, duties, signatures, info_titles)["reasons"]


def coerce(c: Column, synonyms: Mapping[str, str], default: str | None = None) -> Column:
    """A value through a synonym table; unknown values become ``default``, or stay if there is none."""
    table = F.create_map(*(F.lit(x) for kv in synonyms.items() for x in kv))
    return F.coalesce(table[c], F.lit(default) if default is not None else c)


def strict(c: Column, allowed: Mapping[str, str]) -> Column:
    """A value through a table; unknown values are an error."""
    table = F.create_map(*(F.lit(x) for kv in allowed.items() for x in kv))
    return F.coalesce(table[c], F.raise_error(F.concat(F.lit("unknown value: "), text_of(c))))


def category_map(reply: Column, ids: Column, allowed: Sequence[str], default: str = "其他") -> Column:
    """A model's reply as {id: category}: the outermost braces of its text, known ids and allowed categories only."""
    parsed = F.coalesce(F.from_json(F.regexp_extract(text_of(reply), r"(?s)(\{.*\})", 1), "map<string,string>"), F.create_map().cast("map<string,string>"))
    value = lambda k: F.when(parsed[k].isin(*allowed), parsed[k]).otherwise(default)
    return F.map_from_arrays(ids, F.transform(ids, value))


def depth(facts: Column, reasoning: Column, judgment: Column, holding: Column) -> Column:
    """How much of a case is there."""
    has = lambda c: text_of(c) != ""
    return F.when(has(facts) & has(reasoning) & has(judgment), "full").when(has(holding) & has(reasoning), "holding_reasoning").when(has(holding), "holding").when(has(reasoning) | has(facts), "partial").otherwise("title_only")


def status(title: Column) -> Column:
    """superseded only if the title says so."""
    return F.when(F.contains(text_of(title), F.lit("已废止")), "superseded").otherwise("active")


def weight(base: Column, *adjustments: tuple[Column, float], least: float = 0.1) -> Column:
    """A base weight with the adjustments whose conditions hold, at least ``least``, to two places."""
    out = base
    for condition, change in adjustments:
        out = out + F.when(condition, change).otherwise(0.0)
    return F.round(F.greatest(F.lit(least), out), 2)


def merge_domains(raw: Column, inferred: Column, aliases: Mapping[str, str], default: str = "通用") -> Column:
    """Raw domains, split and through an alias table, then inferred ones, each once; the default only alone."""
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    given = F.filter(F.split(text_of(raw), "[/／、,，\\s]+"), lambda x: x != "")
    both = F.array_distinct(F.concat(F.transform(given, lambda x: F.coalesce(table[x], x)), F.coalesce(inferred, F.array().cast("array<string>"))))
    some = F.filter(both, lambda x: x != default)
    return F.when(F.size(some) == 0, F.array(F.lit(default))).otherwise(some)


def prune_tag(domains: Column, tag: str, title: Column, body: Column, proof: str) -> Column:
    """Domains without ``tag`` unless its proof is in the title, or in the body when the tag stands alone."""
    proven = text_of(title).rlike(proof) | ((F.size(domains) == 1) & text_of(body).rlike(proof))
    return F.when(~proven, F.array_remove(domains, tag)).otherwise(domains)
